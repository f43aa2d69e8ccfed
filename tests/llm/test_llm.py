"""The operators on names and texts: brute force, invariants and cases."""

import math
import random
from itertools import product

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crease.llm import canonical, matching, mixing, names, packing, residue
from crease.llm.queries import QUERIES

from ..conftest import DATA


def test_near_tokens_by_brute_force(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(120)]
    df = spark.createDataFrame([(w,) for w in words], "l string")
    got = {tuple(r) for r in names.near_tokens(df, df.withColumnRenamed("l", "r")).collect()}
    for a, b in product(set(words), repeat=2):
        d = names.edit(a, b)
        if d == 0 or (d == 1) or (d == 2 and min(len(a), len(b)) >= 6):
            if abs(len(a) - len(b)) <= 2 and not (d == 1 and len(a) < 3):
                assert (a, b) in got, (a, b)


REGISTER = [("p1", "KM Sharma", "Karan Mohit Sharma", "India", "Batter"), ("p2", "K Sharma", "Kishan Sharma", "India", "Bowler"), ("p3", "B O'Proyash", "Bhola O'Proyash", "Australia", "Batter"), ("p4", "JV du Rushend", "Jobho Vemje du Rushend", "England", "Bowler"), ("p5", "T Lee-Khand", "Tomas Lee-Khand", "Sri Lanka", "Batter")]
SPELLINGS = {
    "K. Sharma": "p2", "Sharma, Karan": "p1", "KARAN SHARMA": "p1", "Karan Mohit Shrama": "p1", "Kishn Sharma (wk)": "p2", "Bhola OProyash": "p3", "BholaO'Proyash": "p3", "Rushend, Jobho du": "p4", "J.V. du Rushend - ENG": "p4", "Tomás Lee Khand": "p5",
    "Tomy Lee-Khand": "p5", "Z Sharma": None, "Nobody Known": None, "": None, None: None, "x" * 5000: None, "KZ Sharma": None,
}


def test_links(spark):
    register = spark.createDataFrame([*REGISTER, REGISTER[0]], "player_id string, player_name string, full_name string, country string, playing_role string")
    rows = [("f", str(i), s, None, None, None, "kept") for i, s in enumerate(SPELLINGS)]
    records = spark.createDataFrame(rows, "source_field string, record_key string, spelling string, country string, role string, list_key string, extra string")
    got = {int(r.record_key): (r.player_id, r.extra) for r in names.link(records, register).collect()}
    for i, (s, want) in enumerate(SPELLINGS.items()):
        assert got.get(i, (None, "kept")) == (want, "kept"), s
    assert names.link(records, register.where("false")).count() == 0


def test_context_decides_between_people(spark):
    register = spark.createDataFrame([("a", "RK Patel", "Ravi Kumar Patel", "India", "Batter"), ("b", "RS Patel", "Rohan Som Patel", "England", "Bowler")], "player_id string, player_name string, full_name string, country string, playing_role string")
    records = spark.createDataFrame([("f", "1", "R. Patel", "Overseas", None, None), ("f", "2", "R. Patel", None, None, "m"), ("f", "3", "R. Patel", None, None, None)], "source_field string, record_key string, spelling string, country string, role string, list_key string")
    lists = spark.createDataFrame([("m", "a")], "list_key string, player_id string")
    assert {r.record_key: r.player_id for r in names.link(records, register, lists).collect()} == {"1": "b", "2": "a"}


GROUNDS = [("v1", "hashen park a", "rebrom"), ("v2", "hashen park b", "rebrom"), ("v3", "sabreed gymkhana ground", "dret"), ("v4", "sabreed gymkhana ground ii", "dret"), ("v5", "dr maayek sports complex", "doneng"), ("v1", "old rebrom field", "rebrom")]
TYPED = {
    "Hashen Park A, Rebrom": "v1", "Rebrom: HASHEN PARK B": "v2", "Hashwn Park A": "v1", "Sabreed Gym. Grd": "v3", "Sponsor Sabreed Gymkhana Ground II": "v4", "Sabreed Gymkhana Ground 2": "v4", "Sabreed Gymkhana Ground IV": None, "Hashen Park C": None,
    "Maayek Spts Cplx": "v5", "The Old Rebrom Field": "v1", "Unseen Oval": None, "y" * 3000: None,
}


@pytest.mark.parametrize("block", [canonical.BLOCK, 2])
def test_grounds(spark, block, monkeypatch):
    entries = spark.createDataFrame([(i, n, c) for i, n, c in GROUNDS], "entry_id string, name string, city string")
    typed = spark.createDataFrame([(t,) for t in TYPED], "t string").withColumn("value", canonical.place_key(F.col("t")))
    monkeypatch.setattr(canonical.mentions, "__defaults__", (block,))
    got = {r.t: r.entry_id for r in typed.join(canonical.map_values(typed, entries), "value").collect()}
    assert got == TYPED
    assert {r.basis for r in canonical.map_values(typed, entries.where("false")).collect()} == {"none"}


def exact_marginals(pairs):
    total, on = 0.0, [0.0] * len(pairs)
    for choice in product((0, 1), repeat=len(pairs)):
        chosen = [p for p, c in zip(pairs, choice) if c]
        if len({p[0] for p in chosen}) == len(chosen) == len({p[1] for p in chosen}):
            weight = math.exp(sum(p[2] for p in chosen))
            total += weight
            on = [o + weight * c for o, c in zip(on, choice)]
    return [o / total for o in on]


def test_propagation_is_exact_on_trees_and_one_to_one(spark):
    pairs = [(1, 11, 2.0), (1, 12, 1.0), (2, 12, 1.5), (3, 13, 0.5), (4, 14, -1.0), (4, 15, 3.0)]
    marginals = matching.propagate(spark.createDataFrame(pairs, "id bigint, id2 bigint, w double"))
    got = {(r.id, r.id2): r.confidence for r in marginals.collect()}
    for p, want in zip(pairs, exact_marginals(pairs)):
        assert got[p[:2]] == pytest.approx(want, abs=2e-3)
    assert {(r.id, r.id2) for r in matching.one_to_one(marginals).collect()} == {(1, 11), (2, 12), (3, 13), (4, 15)}
    assert matching.propagate(spark.createDataFrame([], "id bigint, id2 bigint, w double")).count() == 0


@pytest.mark.parametrize(("a", "b", "near"), [("karan sharma", "k sharma", True), ("karan mohit sharma", "sharma karan", True), ("karansharma", "karan sharma", True), ("km sharma", "karan sharma", True), ("karan sharma", "rohit patel", False), ("", "karan", False), ("karan sharma", "karn shrama", True), ("restyang doo statra", "r du statra", True), ("lodhewim keimsi", "lodhewim kedeemsi", True), ("a " * 4000, "karan sharma", False)])
def test_pairs_of_names(a, b, near):
    assert (matching.pair_cost(a, b) <= 1.5) is near


def test_candidates_are_all_that_pair_cost_accepts(spark):
    names = ["leestilk neesteeng", "ll nisteeng", "p lumkrik", "poyojain loomkrik", "w jirranol", "wedston jeerranol", "thaishiv giwek", "tb geewek", "rosy k", "k rosalind", "li na", "lin a", "edstonjeeranol", "kl rao", "wedstonjeerranol", "mabel ott", "meabl ott", "samit", "asmti", "karan"]
    names += ["a" * 33 + "b", "a" * 32 + " bcd"]
    of = lambda side: [(k + side, 2020, "bikita", None, n, None, None, None) for k, n in enumerate(names)]
    schema = "id bigint, season bigint, place string, nick string, name string, country string, role string, amount double"
    got = {(r.id - 100, r.id2 - 200) for r in matching.candidate_pairs(spark.createDataFrame(of(100), schema), spark.createDataFrame(of(200), schema)).collect()}
    assert got == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if matching.pair_cost(a, b) <= matching.MAX_COST}
    assert {(0, 1), (2, 3), (4, 5), (8, 9), (10, 11), (12, 14)} <= got


SIDE = "id bigint, season bigint, place string, nick string, name string, country string, role string, amount double"


def test_keys_of_names_are_not_shuffled(spark):
    """Names are laid out by season and place; the many keys that they yield are joined where they lie."""
    from crease.sources.tables import in_place

    left, right = (spark.createDataFrame([(k, 2020, "bikita", None, "karan sharma", None, None, None)], SIDE) for k in (1, 2))
    with in_place(spark):
        plan = matching.compared_pairs(left, right)._jdf.queryExecution().executedPlan().toString()
    shuffles = [x.split("hashpartitioning(")[1] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert shuffles and all(x.startswith(("season", "id#")) for x in shuffles), shuffles


def test_a_large_season_and_place_is_cut_in_parts(spark, monkeypatch):
    names_ = ["leestilk neesteeng", "ll nisteeng", "rosy k", "k rosalind", "edstonjeeranol", "wedston jeerranol", "li na", "lin a"] + [f"karan shar{x}a" for x in "mnprst"]
    left, right = (spark.createDataFrame([(k + i, 2020 + i % 2, "bikita", None, n, None, None, None) for i, n in enumerate(names_ * 2)], SIDE) for k in (100, 200))
    whole = {tuple(r) for r in matching.candidate_pairs(left, right).collect()}
    monkeypatch.setattr(matching, "CHUNK", 3)
    rows = [tuple(r) for r in matching.candidate_pairs(left, right).collect()]
    assert len(rows) == len(set(rows)) > 20 and set(rows) == whole


def test_a_durable_result_leaves_no_shuffle_files(spark):
    from crease.sources.tables import discard, durable

    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split()
    before = {x for x in kept() if x.startswith("shuffle")}
    made = durable(spark.range(5000, numPartitions=3).groupBy((F.col("id") % 700).alias("k")).count())
    assert {x for x in kept() if x.startswith("shuffle")} <= before
    discard(made)
    with pytest.raises(Exception, match="(?i)not.exist"):
        made.collect()


def test_weights_are_fitted_and_few_pairs_move_them_little():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        same = rng.random() < 0.9
        pattern = (rng.choice((1, 2, 3)) if same else rng.choice((3, 4, 5, 6)), 1 if same or rng.random() < 0.5 else 2, 1 if same or rng.random() < 0.3 else 2, 1 if same else 3, rng.choice((0, 1)))
        counts[pattern] = counts.get(pattern, 0) + 1
    prior, w = matching.fitted_weights([(*k, n) for k, n in counts.items()])
    odds = lambda p: prior + sum(w[a][x] for a, x in zip(matching.FIRST_WEIGHTS, p))
    assert odds((1, 1, 1, 1, 1)) > 3 and odds((6, 2, 2, 3, 0)) < -3 and w["price"][1] > w["price"][3] and abs(prior - math.log(9)) < 0.7
    assert all(w[a][0] == 0 for a in w)
    few = matching.fitted_weights([(1, 1, 1, 1, 1, 1)])[1]
    assert few["price"][1] - few["price"][3] == pytest.approx(4.0, abs=0.3)
    assert matching.fitted_weights([])[0] == matching.PRIOR


def test_all_marginals_are_published(spark):
    rows = QUERIES["p7_confidence"](spark, str(DATA))
    found = {tuple(r) for r in QUERIES["p7_found"](spark, str(DATA)).collect()}
    assert {(r.lot_id, r.squad_id) for r in rows.where("chosen").collect()} == found and rows.where("not settled or confidence < 0 or confidence > 1").count() == 0


def test_names_that_the_cost_accepts_are_candidates(spark):
    """Recall of the delete keys against every pair of typed names and registered people of the test data."""
    from crease.operators.dimensions import observations

    register = names.register_parts(spark.read.parquet(f"{DATA}/people_register.parquet"))
    parts = [(r.player_id, tuple(r.given), tuple(r.surname)) for r in register.orderBy("player_id").collect()][::8]
    typed = observations(spark, str(DATA)).select(names.clean_name(F.col("name")).alias("clean")).where("clean <> ''").distinct()
    some = [r.clean for r in typed.orderBy("clean").collect()][::6]
    want = {(t, i) for t in some for i, g, s in parts if names.name_cost(t, g, s) <= names.MAX_COST}
    got = names.candidates(spark.createDataFrame([(t,) for t in some], "clean string"), register).where(F.col("cost") <= names.MAX_COST)
    got = {(r.clean, r.player_id) for r in got.collect()}
    assert want and len(want - got) <= 0.02 * len(want), sorted(want - got)[:10]


def test_teams(spark):
    typed = ["Bikita Herons", "The Bikita Herons", "Herons, Bikita", "Herons (Bikita)", "BIKITA HERONS ", "Bikita", "BIKH", None, ""]
    got = [r.t for r in spark.createDataFrame([(t,) for t in typed], "t string").select(matching.team_parts(F.col("t")).alias("t")).collect()]
    assert [(g.place, g.nick) for g in got[:6]] == [("bikita", "herons")] * 5 + [("bikita", None)] and got[6].code == "bikh" and got[7] is None and got[8] is None


@pytest.mark.parametrize("capacity", [64, 512])
def test_packs(capacity):
    rng = random.Random(capacity)
    lengths = [min(capacity, int(rng.paretovariate(1.1) * 8)) for _ in range(4000)] + [0, capacity, capacity]
    packs = packing.pack_lengths(lengths, capacity)
    used = {}
    for p, n in zip(packs, lengths):
        used[p] = used.get(p, 0) + n
    assert max(used.values()) <= capacity and sum(lengths) / (len(used) * capacity) > 0.95
    assert packing.pack_lengths([], capacity) == [] and packs == packing.pack_lengths(lengths, capacity)


def test_every_document_is_packed_once(spark):
    items = spark.createDataFrame([(i, (i * 37) % 90 + 1) for i in range(500)] + [(900, 250), (901, 0), (None, 5)], "doc_id bigint, n_tokens bigint")
    caps = spark.createDataFrame([("p", 100)], "pack_name string, capacity_tokens bigint")
    rows = packing.pack(items, caps, shard_rows=100).collect()
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.from_token == whole.get(r.doc_id, 0)
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
    assert whole == {r.doc_id: r.n_tokens for r in items.where("n_tokens > 0 and doc_id is not null").collect()}
    assert {r.piece for r in rows if r.doc_id != 900} == {0} and len([r for r in rows if r.doc_id == 900]) == 3
    assert packing.pack(items.where("false"), caps).count() == 0


def test_schedule_deviates_less_than_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    blocks = {s: [1.0] * round(w * 400) for s, w in weights.items()}
    seen = dict.fromkeys(weights, 0)
    for slot, (s, k) in enumerate(mixing.pfair(blocks, weights), 1):
        seen[s] += 1
        assert k == seen[s]
        assert all(abs(seen[x] - weights[x] * slot) < 1 for x in weights)
    assert seen == {s: len(b) for s, b in blocks.items()}


def test_mix_deviates_less_than_a_block_in_tokens(spark):
    """Documents of very unequal length, one source with most: at the end of every block each source is near its share."""
    rng = random.Random(4)
    rows = [(i, "abcdefgh"[i % 8] if i % 3 else "a", min(9000, int(rng.paretovariate(0.9) * 60))) for i in range(3000)] + [(9999, "b", 9000)]
    items = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(s, w, 2) for s, w in zip("abcdefgh", (0.34, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.02))], "source string, target_share double, max_repeats bigint")
    mixed = mixing.mix(items, targets, blocks=200).toPandas()
    want = {r.source: r.target_share for r in targets.collect()}
    seen, total, block = dict.fromkeys(want, 0), 0, mixed["block_tokens"].iloc[0]
    by_slot = mixed.groupby(["slot", "source"]).n_tokens.sum()
    assert by_slot.index.get_level_values(0).is_unique and by_slot.max() <= block
    for (_, s), n in by_slot.items():
        seen[s], total = seen[s] + n, total + n
        assert all(abs(seen[x] - want[x] * total) < block for x in want)
    late = mixing.mix(items, targets, blocks=2, sources=1)
    assert late.count() > 0 and late.groupBy("source", "doc_id").count().where("count > 2").count() == 0


def test_any_number_of_sources_is_scheduled_alike(spark):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, "abc"[i % 3], rng.randint(1, 4000)) for i in range(600)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 2)], "source string, target_share double, max_repeats bigint")
    rows = {tuple(r) for r in mixing.mix(items, targets, blocks=20).collect()}
    assert rows == {tuple(r) for r in mixing.mix(items, targets, blocks=20, sources=1).collect()} == {tuple(r) for r in mixing.mix(items, targets, 20, 0).collect()}
    assert {r[0] for r in rows} == set(range(len({r[:2] for r in rows})))


@pytest.mark.parametrize("capacity", [128, 512, 2048])
def test_packs_are_as_few_as_best_fit_needs(capacity):
    rng = random.Random(capacity)
    lengths = [min(capacity - 1, int(rng.paretovariate(1.1) * capacity / 12) + 1) for _ in range(5000)]
    free, best = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [r for r in free if r >= n]
        if fit:
            free.remove(min(fit))
            free.append(min(fit) - n)
        else:
            best += 1
            free.append(capacity - n)
    assert max(packing.pack_lengths(lengths, capacity)) + 1 <= 1.005 * best + 1


def test_more_capacities_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(packing, "FEW_CAPACITIES", 2)
    items = spark.createDataFrame([(1, 10), (2, 25)], "doc_id bigint, n_tokens bigint")
    caps = spark.createDataFrame([(f"p{i}", 10 + i) for i in range(5)], "pack_name string, capacity_tokens bigint")
    got = packing.pack(items, caps).groupBy("pack_name").agg(F.sum("n_tokens").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
    assert len(got) == 5 and all((r.n, r.d) == (35, 2) for r in got)


WITHOUT_PACKAGE = """
import os, sys, shutil, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1500]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.executor.memory", "1g").config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate()
assert not spark.range(1).mapInPandas(lambda it: (b for b in it if not __import__("importlib").util.find_spec("crease")), "id bigint").isEmpty()
from crease.llm.queries import QUERIES
for name in ("p2_found", "p4_found", "p7_found", "p8_packs", "p9_mix", "p10_found"):
    print(name, QUERIES[name](spark, sys.argv[2]).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The queries run on workers that cannot import the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", WITHOUT_PACKAGE, str(Path(__file__).parents[2]), str(DATA)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert len(run.stdout.split()) == 12


def test_mix_reaches_its_shares(spark):
    rows = [(i, "big" if i % 3 else "small", 50 + i % 40) for i in range(1500)] + [(9999, None, 5), (9998, "big", 0)]
    items = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 2), ("absent", 0.0, 1)], "source string, target_share double, max_repeats bigint")
    mixed = mixing.mix(items, targets, blocks=50)
    assert mixed.groupBy("source", "doc_id").count().join(targets, "source").where("count > max_repeats").count() == 0
    got = {r.source: r for r in mixing.reached(mixed, targets).collect()}
    assert abs(got["big"].share - 0.4) < 0.01 and abs(got["small"].share - 0.6) < 0.01 and got["absent"].n_tokens == 0
    assert mixing.mix(items.where("false"), targets).count() == 0


CASES = {
    "The pitch at {{venue}} was slow.": "slot", "Rain took %(result)s overs.": "slot", "before a <<overs>> stroke": "slot", "&lt;player_name&gt; waited": "slot", "cost NaN runs": "slot", "the best [object Object] in the cup": "slot",
    "loudly led by (player name to be filled in).": "slot", "XX-CAPTAIN-XX on 8 points": "slot", "Match ids follow the pattern {competition}:{stem}, so a reload keeps every key.": None, "fills a field written as {{player_name}} in our guide": None,
    'The export line reads {"season": 2022, "sold": true} and was checked.': None, "An undefined result is stored as no result, and NaN averages become null when A was never out.": None, "[Editor: an earlier version gave 43 balls.] We were [laughs] late.": None,
    "A 100% TEAM effort, said the banner; he signed #6 shirts in the <sixth> set.": None, "Use `{{name}}` in code.": None, "Lorem ipsum dolor adipis. Erat nullam porta lorem.": "filler", "This is dummy copy; replace it before publishing. " * 3: "filler",
    "text text text text text text": "filler", "The training drill called lorem, after its inventor, asks him to bowl 34 balls.": None, "Error 401\nPlease try again in a few minutes.\nrequest-id 89770357db": "page", "Please enable JavaScript to view the match centre.": "page",
    '{"error": {"code": 429, "message": "no such match"}}': "page", "The score page returned a 404 for 35 minutes, and the office apologised.": None, "Readers wrote in to say the tracker asked them to enable JavaScript; the widget was replaced.": None,
    "Please try again in a few minutes, the gate staff told ticket holders 3 times.": None, "": None, None: None, "word " * 40_000: "filler", "A long over. " * 10_000: None,
}


def test_residue(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "i int, text string, _other string")
    got = {r.i: r.residue for r in residue.judge(df).collect()}
    for i, (t, want) in enumerate(CASES.items()):
        assert got[i] == want, t and t[:60]
    assert residue.without_residue(df).count() == sum(v is None for v in CASES.values())


MORE_RESIDUE = {
    "404": "page", "Please enable pop-ups to go on.": "page", "bar baz bar baz": "filler", "ccc ddd ccc ddd": "filler", "Oops! Something went wrong. Incident #91621": "page", "503\n\nIncident #7262": "page",
    "कृपया इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें।": "page", "यहाँ नमूना पाठ लिखें। यहाँ नमूना पाठ लिखें।": "filler", "बारिश के कारण मैच 17 ओवर का कर दिया गया।": None,
    "which the captain called [MATCH_DATE] but not decisive": "slot", "bkrimwsp nmdutdg gwgcnbn oed vdk oota dhmb shwleolc kfevggb": "filler", "Veritas cunctarum minor solapis tegnum urbit salva nocturem.": "filler",
    "İstanbul bkrimwsp nmdutdg gwgcnbn oed vdk oota dhmb shwleolc kfevggb": "filler", "Use `{a}`, `{b}`, `{c}` and `{d}` in a line; {e} works too, as the guide says.": None, "Scorers met today. " + "A long over. " * 3000 + "It ended {{when}}.": "slot",
}


def test_residue_by_measure_and_context(spark):
    df = spark.createDataFrame(list(enumerate(MORE_RESIDUE)), "i int, text string")
    got = {r.i: r.residue for r in residue.judge(df).collect()}
    for i, (t, want) in enumerate(MORE_RESIDUE.items()):
        assert got[i] == want, t[:60]


def test_literals_of_rules_are_in_every_match():
    """The search by literals loses nothing: on every document, it finds what all rules on all sentences find."""
    rules, every = residue.Rules(), residue.Rules()
    every.machine = type("All", (), {"iter": lambda self, low: [(i, range(len(every.rules))) for i in range(len(low))]})()
    texts = [t for t in (*CASES, *MORE_RESIDUE) if t and len(t) < 2000] + pq.read_table(DATA / "documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    for t in texts:
        if len(t) < 1500:
            assert rules.residue(t) == every.residue(t), t[:80]


PLAIN: dict = {}
FOUND = ["p2_found", "p4_found", "p7_found", "p10_found", "p8_packs", "p9_mix"]


@pytest.mark.parametrize("name", FOUND)
def test_empty_tables_give_no_rows(spark, variant, name):
    assert QUERIES[name](spark, variant("empty")).count() == 0


@pytest.mark.parametrize(("name", "how"), [("p4_found", "extra"), ("p10_found", "extra"), *((n, "odd") for n in FOUND[:4])])
def test_odd_rows_change_nothing_else(spark, variant, name, how):
    if name not in PLAIN:
        PLAIN[name] = {tuple(r) for r in QUERIES[name](spark, str(DATA)).collect()}
    before = PLAIN[name]
    rows = [tuple(r) for r in QUERIES[name](spark, variant(how)).collect()]
    assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)
    assert set(rows) == before if how == "extra" else len(before - set(rows)) <= 0.05 * len(before)


def test_packing_and_mixing_with_odd_rows(spark, variant):
    for name in ("p8_packs", "p9_mix"):
        assert QUERIES[name](spark, variant("odd")).where("doc_id is null or n_tokens is null").count() == 0


def test_token_counts_follow_the_whole_text(spark):
    from crease.llm.tokens import TOKENIZERS, VOCABULARY, encoder, with_tokens

    texts = ["A short text.", "", None, "word and more words " * 12_000, ("two  blanks\n " * 9_000 + "(" * 50_000) * 2]
    got = [r.n_tokens for r in with_tokens(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    enc = encoder(TOKENIZERS, VOCABULARY)
    assert got == [len(enc.encode_ordinary(t or "")) for t in texts]
    assert pq.read_table(DATA / "documents.parquet", columns=["doc_id"]).num_rows > 0
