"""Lookups, ranks, the identity layer, contracts and models against brute force and planted faults."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from crease.errors import ContractError, LookupMissing, QualityError
from crease.functions.lookups import is_subset, ranked_best, require_all_found, with_lookup, with_required_lookup
from crease.functions.prefix import dense_ranks, medians, rank_percentiles, value_counts_before
from crease.operators import identity, validation
from crease.operators.dimensions import category, violations
from crease.operators.leagues import crossover_ratio, translated
from crease.operators.models import alpha_by_folds, least_squares, one_hot

from .conftest import DATA


def test_guarded_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    dim = spark.createDataFrame([(1, "x"), (1, "x"), (3, "z"), (None, "n")], "k int, w string")
    assert {(r.v, r.w) for r in with_lookup(df, dim, ["k"]).collect()} == {("a", "x"), ("b", None), ("c", None)}
    twice = dim.union(spark.createDataFrame([(1, "y")], dim.schema))
    with pytest.raises(Exception, match="key twice: 1"):
        with_lookup(df, twice, ["k"]).collect()
    with pytest.raises(Exception, match="no lookup row for: "):
        with_required_lookup(df, dim, ["k"]).collect()
    assert with_required_lookup(df.where("k = 1"), dim, ["k"]).first().w == "x"
    with pytest.raises(LookupMissing, match="2 rows"):
        require_all_found(df, dim, ["k"])
    assert is_subset(df, dim, ["k"]).first().n_missing == 2 and is_subset(dim.where("k = 1"), df, ["k"]).first().is_subset
    assert with_lookup(df.where("false"), dim, ["k"]).count() == 0


def test_ranked_best(spark):
    df = spark.createDataFrame([("a", "low"), ("a", "exact"), ("b", "odd"), ("b", "unresolved"), ("c", None)], "k string, c string")
    got = {r.k: r.b for r in df.groupBy("k").agg(ranked_best(F.col("c"), identity.CONFIDENCE_RANK).alias("b")).collect()}
    assert got == {"a": "exact", "b": "unresolved", "c": None}


def test_ranks_and_medians_by_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [("ab"[int(rng.integers(2))], None if rng.random() < 0.1 else float(rng.integers(30)) / 4) for _ in range(700)] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    of = lambda k: sorted(v for g, v in rows if g == k and v is not None)
    for r in rank_percentiles(df, ["k"], "v", "p").collect():
        if r.v is None:
            assert r.p is None
        else:
            x = of(r.k)
            assert r.p == pytest.approx((sum(y < r.v for y in x) + (sum(y == r.v for y in x) + 1) / 2) / len(x))
    high = {(r.k, r.v): r.p for r in rank_percentiles(df, ["k"], "v", "p", highest_first=True).collect()}
    low = {(r.k, r.v): r.p for r in rank_percentiles(df, ["k"], "v", "p").collect()}
    assert all(high[k] == pytest.approx(1 + 1 / len(of(k[0])) - low[k]) for k in low if k[1] is not None)
    assert {r.k: r.m for r in medians(df, ["k"], "v", "m").collect()} == {k: float(np.median(of(k))) for k in "abc"}
    assert medians(df, [], "v", "m").first().m == float(np.median([v for _, v in rows if v is not None]))
    assert medians(df.where("false"), ["k"], "v", "m").count() == 0 == value_counts_before(df.where("false"), [], "v").count()
    values = sorted({v for _, v in rows if v is not None})
    assert {(r.v, r.n) for r in dense_ranks(df, "v", "n").collect()} == {(v, i) for i, v in enumerate(values, 1)} | {(None, None)}


def test_mapping_lookups_keep_the_right_writer(spark):
    schema = "place int, source_name string, canonical_id string, canonical_name string, method string, confidence string"
    mapped = spark.createDataFrame([(0, "K. Rao", "1", "K Rao", "exact_match", "exact"), (1, "K Rao", "2", "K Rao", "m", "low"), (2, "K. Rao", "3", "KL Rao", "m", "low")], schema)
    df = spark.createDataFrame([("K. Rao", "x"), ("k  rao!", "x"), (" ", "x"), (None, "x"), ("L Rao", "x")], "name string, method string")
    got = [(r.name_canonical_id, r.name_mapping_method) for r in identity.resolve(df, "name", mapped).collect()]
    assert sorted(got) == sorted([("3", "m"), ("1", "exact_match_normalized"), ("NA", "none"), ("NA", "none"), ("UNRESOLVED", "unresolved")])
    assert identity.resolve(df, "name", mapped.where("false")).count() == 5


def test_files_are_mapped_in_place(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/x.csv").write_text("Name,v\nK Rao,1\n,2\nL Rao,3\n")
    (tmp_path / "in/y.csv").write_text("v\n1\n")
    mapped = spark.createDataFrame([("K Rao", "1", "K Rao", "exact_match", "exact")], "source_name string, canonical_id string, canonical_name string, method string, confidence string")
    report = identity.map_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), mapped).collect()
    assert [tuple(r) for r in report] == [("a/x.csv", "Name", 2, 1)]
    got = {r.v: r.Name_canonical_id for r in spark.read.option("header", True).csv(str(tmp_path / "out/a/x.csv")).collect()}
    assert got == {"1": "1", "2": "NA", "3": "UNRESOLVED"} and not (tmp_path / "out/y.csv").exists()
    assert identity.map_files(spark, str(tmp_path / "none"), str(tmp_path / "out2"), mapped).count() == 0


def test_name_pairs_by_brute_force(spark):
    names = ["Anil Bosehari Kumarappan", "Anil Bosehary Kumarappan", "AnilBosehariKumarappan", "Bnil Bosehari Kumarappan", "Xavi Lee", "Xavi-Lee", "Anil Boseharu Dumarappan", "A", ""]
    seasons = [("Bnil Bosehari Kumarappan", "T 1"), ("Anil Bosehari Kumarappan", "T 1"), ("Xavi Lee", "T 2"), ("Anil Boseharu Dumarappan", "T 3")]
    compact = lambda n: "".join(c for c in n.lower() if c.isalnum())
    initials = lambda n: "".join(w[0] for w in "".join(c if c.isalpha() else " " for c in n.lower()).split())
    at = lambda n: {s for m, s in seasons if m == n}
    want = set()
    for a in names:
        for b in names:
            if a < b and compact(a) and compact(b):
                same, shared = compact(a) == compact(b), at(a) & at(b)
                block = len(compact(a)) == len(compact(b)) and compact(a)[0] == compact(b)[0]
                near = SequenceMatcher(None, compact(a), compact(b)).ratio() >= 0.94
                if same or (block and near and (initials(a) == initials(b) or shared)):
                    want.add((a, b, "high_candidate" if same else "medium_candidate" if shared else "low_candidate"))
    got = identity.name_pairs(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(seasons, "name string, team_season string"))
    assert {(r.name_1, r.name_2, r.confidence) for r in got.collect()} == want and want


def test_reports_and_review_of_names(spark):
    assert "exactly one bucket" in identity.audit_report(spark, str(DATA))
    review = identity.unresolved_review(spark, str(DATA))
    rows = review.collect()
    assert rows and len({r.source_name for r in rows}) == len(rows)
    assert all(r.score_1 is None or r.score_2 is None or r.score_1 >= r.score_2 >= 0.7 for r in rows)


RECORD = dict(zip(validation.AUCTION_COLUMNS, ("2020", "A B", "Indian", "Bowler", "Capped", "20", "INR", "50", "INR", "Team", "f.csv")))


@pytest.mark.parametrize(
    ("change", "rule"),
    [({"nationality": "Martian"}, "nationality is allowed"), ({"role": "Coach"}, "role is allowed"), ({"sold_price": "x"}, "sold_price is a number"), ({"base_price": "-1"}, "base_price not negative"),
     ({"sold_price_currency": ""}, "sold_price has a currency"), ({"year": "1999"}, "year in range"), ({"year": "x"}, "year is a number"), ({"team_name": ""}, "team_name not empty"), ({"sold_price": ""}, "sold_price not empty")],
)
def test_auction_contract(spark, change, rule):
    schema = ", ".join(f"{c} string" for c in validation.AUCTION_COLUMNS)
    good = spark.createDataFrame([tuple(RECORD.values())], schema)
    validation.enforce(validation.auction_contract(good))
    bad = spark.createDataFrame([tuple((RECORD | change).values())], schema)
    with pytest.raises(QualityError, match=rule):
        validation.enforce(validation.auction_contract(bad))
    with pytest.raises(QualityError, match="record occurs once: 2 of 2"):
        validation.enforce(validation.auction_contract(good.union(good)))
    with pytest.raises(ContractError, match="missing column role"):
        validation.auction_contract(good.drop("role"))


@pytest.mark.parametrize(
    ("change", "rule"),
    [({"total_runs": 9}, "total is bat plus extras"), ({"wides_runs": 1}, "wides_runs as in extras"), ({"is_legal_ball": False}, "legal ball has no wide or no-ball"), ({"legal_ball_number": None}, "legal ball has a number"),
     ({"dismissal_count": 2}, "dismissals as in wickets"), ({"wickets_json": "[{"}, "wickets_json is JSON"), ({"batter": None}, "required fields present"), ({"delivery_key": "x"}, "key has its parts"), ({"batter_runs": -1}, "runs not negative"),
     ({"over_number": -1}, "over number from 0"), ({"source_path": "data/psl/1.json"}, "path names the competition")],
)
def test_delivery_rules(spark, change, rule):
    row = dict.fromkeys(validation.DELIVERY_TYPES) | {
        "delivery_key": "ipl:1:1:0:1", "match_id": "ipl:1", "source_match_id": "1", "competition": "ipl", "source_path": "data/ipl/1.json", "batter": "a", "bowler": "b", "non_striker": "c", "innings_number": 1, "over_number": 0,
        "delivery_in_over": 1, "legal_ball_number": 1, "is_legal_ball": True, "is_super_over": False, "dismissal_count": 0, "wickets_json": "[]", "extras_json": '{"byes":1}', "byes_runs": 1, "batter_runs": 1, "extra_runs": 1, "total_runs": 2,
        "wides_runs": 0, "noballs_runs": 0, "legbyes_runs": 0, "penalty_runs": 0,
    }
    schema = ", ".join(f"{c} {t}" for c, t in validation.DELIVERY_TYPES.items())
    of = lambda r: spark.createDataFrame([tuple(r[c] for c in validation.DELIVERY_TYPES)], schema)
    validation.enforce(violations(of(row), validation.delivery_rules()))
    with pytest.raises(QualityError, match=rule):
        validation.enforce(violations(of(row | change), validation.delivery_rules()))


def test_gate_and_schema(spark):
    assert validation.run_all(spark, str(DATA)).where("n_rows > 0").count() > 40
    validation.require_no_leakage(spark, str(DATA))
    df = spark.createDataFrame([(1, "x")], "a int, loaded_at string")
    assert validation.schema_problems(df, {"a": "bigint", "b": "string"}) == ["missing column b", "a is int, not bigint"]
    assert validation.schema_problems(df.withColumn("c", F.lit(1)), {"a": "int"}) == ["unexpected column c"]


def test_categories(spark):
    names = ["ipl", "Indian Premier League", "bbl", "The Hundred", "Syed Mushtaq Ali Trophy", "t20i", "hnd", None]
    got = [r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select(category(F.col("n")).alias("c")).collect()]
    assert got == ["IPL", "IPL", "Overseas Franchise", "Overseas Franchise", "Domestic", "International", "Domestic", "Other"]


def test_crossover_ratio(spark):
    rows = [("ipl", "a", 20.0, 5), ("bbl", "a", 30.0, 5), ("ipl", "b", 40.0, 5), ("bbl", "b", 20.0, 5), ("cpl", "a", 10.0, 4), ("bbl", "c", 90.0, 9)]
    got = crossover_ratio(spark.createDataFrame(rows, "competition string, player string, rate double, outs int"), F.col("outs") >= 5, "batting").collect()
    assert [(r.competition, r.batting_ratio, r.n_batting) for r in got] == [("bbl", 1.0, 2)]


def test_translated(spark):
    rows = [("a", 1, 10.0), ("a", 2, 30.0), ("b", 1, 20.0), ("b", 2, 22.0), ("c", 1, None), ("d", 1, 30.0)]
    got = {(r.player, r.start_year): r for r in translated(spark.createDataFrame(rows, "player string, start_year int, v double"), {"v": True}).collect()}
    assert [got[p, 1].v_percentile for p in "abcd"] == pytest.approx([1 / 3, 2 / 3, None, 1.0]) and got["b", 1].v_dominance == 1.0
    assert (got["a", 1].v_variance_flag, got["b", 1].v_variance_flag, got["d", 1].v_variance_flag) == (True, False, None)


def test_alpha_by_folds_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), None if rng.random() < 0.2 else float(rng.normal()), float(rng.normal()), float(rng.normal())) for y in rng.integers(2014, 2020, 400)]
    df = spark.createDataFrame(rows, "year bigint, a double, b double, t double").withColumn("y", F.col("t") + F.coalesce("a", F.lit(0.0)))
    data = np.array([[np.nan if x is None else x for x in r] for r in df.select("year", "a", "b", "y").collect()], dtype=float)
    want = {}
    for alpha in (0.1, 100.0):
        errors = []
        for year in (2016, 2017, 2018):
            tr, te = data[data[:, 0] < year], data[data[:, 0] == year]
            med = np.nanmedian(tr[:, 1:3], axis=0)
            fill = lambda x: np.where(np.isnan(x), med, x)  # noqa: B023, E731
            X, Y = fill(tr[:, 1:3]), tr[:, 3]
            mu, sd = X.mean(0), X.std(0)
            w = np.linalg.solve(((X - mu) / sd).T @ ((X - mu) / sd) + alpha * np.eye(2), ((X - mu) / sd).T @ (Y - Y.mean()))
            errors.append(np.abs(te[:, 3] - ((fill(te[:, 1:3]) - mu) / sd @ w + Y.mean())))
        want[alpha] = np.concatenate(errors).mean()
    got = {r.alpha: (r.cv_log_mae, r.is_best) for r in alpha_by_folds(df, ["a", "b"], "y", 2016, 2018, least=50, alphas=(0.1, 100.0)).collect()}
    assert {a: g[0] for a, g in got.items()} == pytest.approx(want, abs=2e-6) and [a for a, g in got.items() if g[1]] == [min(want, key=want.get)]
    assert alpha_by_folds(df.where("false"), ["a", "b"], "y", 2016, 2018).count() == 0


def test_one_hot_and_least_squares(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", -5.0), (None, 1.0), ("y", 3.0)], "c string, v double")
    levels, hot = one_hot(df, "c")
    assert levels == ["y", "z"]
    p = least_squares(df, [F.lit(1.0), *hot], F.col("v"))
    assert {(r.c, round(r.p, 6)) for r in df.select("c", p.alias("p")).collect()} == {("x", 1.0), ("y", 3.0), ("z", 0.0), (None, 1.0)}
    with pytest.raises(ContractError, match="more than 2 levels"):
        one_hot(df, "c", most=2)


def test_names_to_show_read_the_fact_once_and_join_none_of_its_rows(spark):
    plan = identity.display_names(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert len([x for x in plan.splitlines() if "Relation [" in x and "delivery_key#" in x]) == 1
