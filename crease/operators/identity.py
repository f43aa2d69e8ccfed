"""The identity layer: the mapping of observed names to registered people, its use, its evidence and its reports.

A name is mapped by the first tier that finds exactly one person (exact name, then surname with initials); all other
names stay unresolved, with the reason. Features that need a known person read ``resolved_fact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.errors import SourceError
from crease.functions.lookups import ranked_best
from crease.functions.scalars import compact_key, name_key, name_tokens
from crease.operators.dimensions import OBS_SQL, SALTS, SPREAD, fuzzy_candidates, identity_audit, letters, observations, participation, reach, similar
from crease.operators.dimensions import SQL as DIMENSION_SQL
from crease.operators.facts import FACT_SQL, fact, long, population
from crease.sources.files import csv_texts, markdown, write_table
from crease.sources.tables import durable, once, table

# How sure a way of mapping is, best first.
CONFIDENCE_RANK = {"exact": 0, "high": 1, "medium": 2, "low": 3, "unresolved": 4}
UNRESOLVED = "UNRESOLVED"


def mapping(spark: SparkSession, base: str) -> DataFrame:
    """(source_name, canonical_id, canonical_name, method, confidence) of every observed name that is mapped.

    Exact names, and names whose surname and initials belong to one person. The compact-spelling tier is not mapped
    by itself; ``resolve`` reaches such names through their normalised form.
    """
    audit = identity_audit(spark, base).where("bucket in ('exact', 'initials', 'surname')")
    people = table(spark, base, "people_register").groupBy("player_id").agg(F.min("player_name").alias("canonical_name"))
    exact = F.col("bucket") == "exact"
    rows = audit.join(people, "player_id")
    return rows.select(
        F.col("name").alias("source_name"), F.col("player_id").alias("canonical_id"), "canonical_name",
        F.when(exact, "exact_match").otherwise("initials_pattern_match").alias("method"), F.when(exact, "exact").otherwise("medium").alias("confidence"),
    )


def kept_mapping(spark: SparkSession, base: str) -> DataFrame:
    """The mapping, made once for a session."""
    return once(spark, "mapping", table(spark, base, "deliveries"), lambda: mapping(spark, base))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A mapping file: a JSON object whose ``mapped`` is a list of entries. SourceError where it has none."""
    entry = "struct<source_name:string,canonical_id:string,canonical_name:string,method:string,confidence:string>"
    raw = spark.read.schema(f"mapped array<{entry}>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("mapped").alias("place", "m")).select("place", "m.*")
    if rows.isEmpty():
        raise SourceError(f"no mapped entries in {path}")
    return rows


def lookups(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exact, normalised): one entry for each source name, the last written; one for each normalised name, the first
    written (in the order of ``place`` where the mapping has it, else of the names)."""
    order = F.col("place") if "place" in mapped.columns else F.col("source_name")
    entry = F.struct("canonical_id", "canonical_name", "method")
    rows = mapped.withColumns({"o": order, "entry": entry, "key": name_key(F.col("source_name"))})
    exact = rows.groupBy("source_name").agg(F.max_by("entry", F.struct("o", "entry")).alias("exact"))
    normal = rows.where("key <> ''").groupBy("key").agg(F.min_by("entry", F.struct("o", "source_name")).alias("normal"))
    return exact, normal


def resolve(df: DataFrame, column: str, mapped: DataFrame) -> DataFrame:
    """df + {column}_canonical_id, _canonical_name and _mapping_method.

    The trimmed name exactly, else its normalised form (method + "_normalized"); blank names are NA, others UNRESOLVED
    under their own name. Any other column is kept; NULL names are blank.
    """
    exact, normal = lookups(mapped)
    typed = F.trim(F.coalesce(F.col(column), F.lit("")))
    rows = df.withColumns({"_typed": typed, "_key": name_key(typed)})
    rows = rows.join(exact.withColumnRenamed("source_name", "_typed"), "_typed", "left").join(normal.withColumnRenamed("key", "_key"), "_key", "left")
    blank = F.col("_typed") == ""
    pick = lambda c, none: F.when(blank, "NA").otherwise(F.coalesce(F.col(f"exact.{c}"), F.col(f"normal.{c}"), none))
    by = F.when(blank, "none").otherwise(F.coalesce("exact.method", F.concat("normal.method", F.lit("_normalized")), F.lit("unresolved")))
    out = {
        f"{column}_canonical_id": pick("canonical_id", F.lit(UNRESOLVED)), f"{column}_canonical_name": pick("canonical_name", F.col("_typed")),
        f"{column}_mapping_method": by,
    }
    return rows.withColumns(out).select(*df.columns, *out)


#: Columns of a file of unknown layout that hold people's names.
NAME_COLUMNS = ("Name", "player_name", "name", "unique_name", "batter", "bowler", "player")


def map_files(spark: SparkSession, root: str, out: str, mapped: DataFrame) -> DataFrame:
    """Writes every CSV file below ``root`` to the same place below ``out``, with the mapped person beside each column of
    names; (path, column, n_names, n_mapped) of what was written. A file without such a column is left out."""
    from pathlib import Path

    report = None
    mapped = durable(mapped)
    for path in sorted(Path(root).rglob("*.csv")):
        rows = csv_texts(spark, str(path))
        columns = [c for c in NAME_COLUMNS if c in rows.columns]
        for c in columns:
            rows = resolve(rows, c, mapped)
        if columns:
            place = path.relative_to(root)
            write_table(rows, f"{out}/{place}", format="csv")
            for c in columns:
                named = F.col(f"{c}_canonical_id") != "NA"
                line = rows.agg(F.count_if(named).alias("n_names"), F.count_if(named & (F.col(f"{c}_canonical_id") != UNRESOLVED)).alias("n_mapped"))
                line = line.select(F.lit(str(place)).alias("path"), F.lit(c).alias("column"), "n_names", "n_mapped")
                report = line if report is None else report.unionByName(line)
    return spark.createDataFrame([], "path string, column string, n_names bigint, n_mapped bigint") if report is None else report


def resolved_names(spark: SparkSession, base: str) -> DataFrame:
    """Each batter as typed, with its balls and whom it is mapped to."""
    d = table(spark, base, "deliveries").select("delivery_key", "batter").dropDuplicates(["delivery_key"])
    return resolve(d.groupBy("batter").agg(F.count("*").alias("balls")), "batter", kept_mapping(spark, base))


def resolved_fact(spark: SparkSession, base: str) -> DataFrame:
    """The standard population with batter and bowler ids. Names are resolved once each, not row by row."""
    rows = population(fact(spark, base))
    names = rows.select(F.explode(F.array_distinct(F.array("batter", "bowler"))).alias("n")).distinct()
    ids = resolve(names, "n", kept_mapping(spark, base)).select("n", F.col("n_canonical_id").alias("id"))
    of = lambda c: ids.select(F.col("n").alias(c), F.col("id").alias(f"{c}_id"))
    return rows.join(of("batter"), "batter", "left").join(of("bowler"), "bowler", "left")


def resolved_batting(spark: SparkSession, base: str) -> DataFrame:
    """Season batting by resolved person: UNRESOLVED and blank names are left out, spellings of one person add up."""
    rows = resolved_fact(spark, base).where(~F.col("batter_id").isin(UNRESOLVED, "NA"))
    g = rows.groupBy(F.col("batter_id").alias("player_id"), "start_year")
    return g.agg(F.count_distinct("batter").alias("n_spellings"), long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"))


def population_counts(spark: SparkSession, base: str) -> DataFrame:
    """How many rows of the fact pass each condition of the standard population, one after the other, by league."""
    rows = population(fact(spark, base), gender=None)
    ids = resolved_fact(spark, base).where(~F.col("batter_id").isin(UNRESOLVED, "NA")).groupBy("competition").agg(F.count("*").alias("n_resolved"))
    every = fact(spark, base).groupBy("competition").agg(F.count("*").alias("n_rows"))
    known = rows.groupBy("competition").agg(F.count("*").alias("n_seasons"), F.count_if(F.col("gender") == "male").alias("n_gender"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(known, "competition", "left").join(ids, "competition", "left").select("competition", "n_rows", zero("n_seasons"), zero("n_gender"), zero("n_resolved"))


def collapsed(spark: SparkSession, base: str) -> DataFrame:
    """One row for each mapped person: all its spellings, ways of mapping and the surest of their confidences."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "|")
    rows = kept_mapping(spark, base).where(F.trim("canonical_id") != "").where(F.col("canonical_id") != UNRESOLVED)
    return rows.groupBy(F.col("canonical_id").alias("player_id")).agg(
        F.mode("canonical_name", True).alias("player_name"), F.count_distinct("source_name").alias("n_source_names"), joined("source_name").alias("source_names"),
        joined("method").alias("mapping_methods"), ranked_best(F.col("confidence"), CONFIDENCE_RANK).alias("mapping_confidence"),
    )


def display_names(spark: SparkSession, base: str) -> DataFrame:
    """player_id and the name to show: the registered one, else a batter's, else a bowler's spelling (ties by name)."""
    people = table(spark, base, "people_register").select("player_id", "player_name", F.lit(0).alias("place")).distinct()
    # Spellings are resolved once each; no row of the fact is joined.
    seen = lambda c, k: F.struct(F.col(c).alias("player_name"), F.lit(k).alias("place"))
    spelt = population(fact(spark, base)).select(F.inline(F.array(seen("batter", 1), seen("bowler", 2)))).distinct()
    spelt = resolve(spelt, "player_name", kept_mapping(spark, base)).select(F.col("player_name_canonical_id").alias("player_id"), "player_name", "place")
    every = people.unionByName(spelt).where(~F.col("player_id").isin(UNRESOLVED, "NA"))
    return every.groupBy("player_id").agg(F.min_by("player_name", F.struct("place", "player_name")).alias("player_name"))


def evidence(spark: SparkSession, base: str) -> DataFrame:
    """The teams and seasons each listed name played for."""
    at = F.concat_ws(" ", F.col("team"), F.col("season"))
    rows = participation(spark, base).where("player is not null and team is not null and season is not null")
    seen = rows.groupBy(F.col("player").alias("name")).agg(F.array_sort(F.collect_set(at)).alias("s"))
    return seen.select("name", F.size("s").alias("n_team_seasons"), F.array_join("s", "|").alias("team_seasons"))


def reference_names(spark: SparkSession, base: str) -> DataFrame:
    """Every name of the register and of the team lists, once."""
    people = table(spark, base, "people_register").select(F.explode(F.array("player_name", "full_name")).alias("name"))
    return people.unionByName(participation(spark, base).select(F.col("player").alias("name"))).where("name is not null").distinct()


def signature(c: Column) -> Column:
    """The first letters of all words of a name."""
    return F.array_join(F.transform(name_tokens(c), lambda t: F.substring(t, 1, 1)), "")


def name_pairs(names: DataFrame, seasons: DataFrame, least: float = 0.94) -> DataFrame:
    """(name_1, name_2, similarity, n_shared, confidence): pairs of names that may be one person, name_1 < name_2.

    Names with the same compact spelling; and names of one length and first letter of the compact spelling that are at
    least that similar and have the same initials, or a team and season in common. seasons: (name, team_season).
    """
    v = names.select("name", compact_key(F.col("name")).alias("c"), signature(F.col("name")).alias("s")).where("c <> ''")
    v = v.withColumns({"n": F.length("c"), "h": F.substring("c", 1, 1), "letters": letters(F.col("c"))})
    a, b = v.select(*[F.col(x).alias(f"{x}_1") for x in v.columns]), v.select(*[F.col(x).alias(f"{x}_2") for x in v.columns])
    ordered = F.col("name_1") < F.col("name_2")
    close = reach("letters_1", "letters_2", F.col("n_1") + F.col("n_2")) >= least - 1e-9
    # Salts spread a common block: each name of one side in one part, each of the other in all of them.
    salted = a.withColumn("salt", F.pmod(F.hash("name_1"), F.lit(SALTS))).repartition(SPREAD, "h_1", "n_1", "s_1", "salt")
    spread = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(SPREAD, "h_2", "n_2", "s_2", "salt")
    block = (F.col("h_1") == F.col("h_2")) & (F.col("n_1") == F.col("n_2"))
    by_initials = salted.alias("x").hint("merge").join(spread.alias("y"), block & (F.col("s_1") == F.col("s_2")) & (F.col("x.salt") == F.col("y.salt"))).where(ordered & close)
    same = a.join(b, F.col("c_1") == F.col("c_2")).where(ordered)
    at = seasons.select("name", "team_season").distinct()
    one, two = at.select(F.col("name").alias("name_1"), "team_season"), at.select(F.col("name").alias("name_2"), "team_season")
    met = one.join(a, "name_1").hint("merge").join(two.join(b, "name_2"), (one.team_season == two.team_season) & block).where(ordered & close)
    columns = ["name_1", "c_1", "s_1", "name_2", "c_2", "s_2"]
    pairs = by_initials.select(*columns).union(same.select(*columns)).union(met.select(*columns)).distinct()
    shared = pairs.join(one, "name_1").join(two, ["name_2", "team_season"]).groupBy("name_1", "name_2").agg(F.count("*").alias("n_shared"))
    scored = similar(pairs.join(shared, ["name_1", "name_2"], "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0))), "c_1", "c_2", least)
    equal = F.col("c_1") == F.col("c_2")
    scored = scored.where(equal | (F.col("similarity").isNotNull() & ((F.col("s_1") == F.col("s_2")) | (F.col("n_shared") > 0))))
    confidence = F.when(equal, "high_candidate").when(F.col("n_shared") > 0, "medium_candidate").otherwise("low_candidate")
    return scored.select("name_1", "name_2", F.when(equal, 1.0).otherwise(F.col("similarity")).alias("similarity"), "n_shared", confidence.alias("confidence"))


def identity_pairs(spark: SparkSession, base: str) -> DataFrame:
    rows = participation(spark, base).where("player is not null and team is not null and season is not null")
    return name_pairs(reference_names(spark, base), rows.select(F.col("player").alias("name"), F.concat_ws(" ", "team", "season").alias("team_season")))


def candidate_people(spark: SparkSession, base: str) -> DataFrame:
    """Whom a pair of names stands for: the people whose name is the second exactly, else whose compact spelling is that
    of either; with how many people that are."""
    pairs = identity_pairs(spark, base).select("name_1", "name_2")
    people = table(spark, base, "people_register").select("player_id", F.explode(F.array("player_name", "full_name")).alias("n")).distinct()
    ids = lambda rows, keys: rows.groupBy(*keys).agg(F.array_sort(F.collect_set("player_id")).alias("ids"))
    exact = ids(people, ["n"]).select(F.col("n").alias("name_2"), F.col("ids").alias("exact"))
    compact = ids(people.select("player_id", compact_key(F.col("n")).alias("c")), ["c"])
    of = lambda k: compact.select(F.col("c").alias(f"c_{k}"), F.col("ids").alias(f"ids_{k}"))
    rows = pairs.withColumns({"c_1": compact_key(F.col("name_1")), "c_2": compact_key(F.col("name_2"))})
    rows = rows.join(exact, "name_2", "left").join(of(1), "c_1", "left").join(of(2), "c_2", "left")
    none = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("ids_1", none), F.coalesce("ids_2", none)))
    found = F.coalesce("exact", both)
    return rows.select("name_1", "name_2", F.size(found).alias("n_people"), F.array_join(found, "|").alias("player_ids"))


def reconciliation(spark: SparkSession, base: str) -> DataFrame:
    """Names by bucket, with the names that are in more than one bucket (none may be) and the names observed in all."""
    audit = identity_audit(spark, base).select("name", "bucket")
    many = audit.groupBy("name").agg(F.count_distinct("bucket").alias("k")).where("k > 1").agg(F.count("*").alias("n_overlaps"))
    total = observations(spark, base).select("name").distinct().agg(F.count("*").alias("n_observed"))
    return audit.groupBy("bucket").agg(F.count("*").alias("n_names")).crossJoin(F.broadcast(many)).crossJoin(F.broadcast(total))


def unresolved_review(spark: SparkSession, base: str) -> DataFrame:
    """Each name that nobody is mapped to, with its two best suggestions side by side (NULL where there are none)."""
    names = identity_audit(spark, base).where("bucket in ('unmatched', 'ambiguous')").select(F.col("name").alias("source_name"), F.col("bucket").alias("category"))
    best = fuzzy_candidates(spark, base, keep=2)
    wide = best.groupBy(F.col("name").alias("source_name")).agg(*[
        F.max(F.when(F.col("place") == k, F.col(c))).alias(f"{n}_{k}") for k in (1, 2) for c, n in (("player_id", "suggested_id"), ("player_name", "suggested_name"), ("similarity", "score"))
    ])
    return names.join(wide, "source_name", "left")


def audit_report(spark: SparkSession, base: str) -> str:
    """The reconciliation as a Markdown report for people."""
    counts = reconciliation(spark, base).orderBy("bucket")
    overlaps = counts.agg(F.coalesce(F.max("n_overlaps"), F.lit(0)).alias("n")).first()["n"]
    told = "Every name is in exactly one bucket." if overlaps == 0 else f"{overlaps} names are in more than one bucket."
    return f"# Identity audit\n\n{told}\n\n{markdown(counts)}\n"


def key_players(spark: SparkSession, base: str, pattern: str = "(?i)sharma|kohli|praiprod|dhoni") -> DataFrame:
    """Observed names that hold one of some words in any case; a NULL name holds none."""
    return observations(spark, base).where(F.coalesce(F.col("name").rlike(pattern), F.lit(False))).select("name", "batter", "bowler")


def newcomers(spark: SparkSession, base: str) -> DataFrame:
    """Every resolved person with whether it was seen in the main league; one that no row tells of is false."""
    rows = resolved_fact(spark, base)
    seen = rows.select("competition", F.explode(F.array("batter_id", "bowler_id")).alias("player_id")).where(~F.col("player_id").isin(UNRESOLVED, "NA"))
    main = seen.where("competition = 'ipl'").select("player_id").distinct().withColumn("in_main", F.lit(True))
    people = table(spark, base, "people_register").select("player_id").distinct()
    return people.join(main, "player_id", "left").select("player_id", F.coalesce("in_main", F.lit(False)).alias("in_main"))


QUERIES = {
    "e06_mapping": mapping, "s13_resolved": resolved_names, "pred05_resolved_batting": resolved_batting, "pred14_population": population_counts, "a09_collapsed": collapsed, "y11_names": display_names,
    "e11_evidence": evidence, "e11_reference_names": reference_names, "j16_identity_pairs": identity_pairs, "e12_candidates": candidate_people, "u08_reconciliation": reconciliation,
    "e10_review": unresolved_review, "pred06_key_players": key_players, "j21_newcomers": newcomers,
}

NAME_KEY = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))".format
AUDIT = DIMENSION_SQL["e05_identity_audit"]
MAP_SQL = f"""au as ({AUDIT}), mp as (select name source_name, au.player_id canonical_id, r.n canonical_name,
   case when bucket = 'exact' then 'exact_match' else 'initials_pattern_match' end as method, case when bucket = 'exact' then 'exact' else 'medium' end as confidence
   from au join (select player_id, min(player_name) n from people_register group by 1) r on r.player_id = au.player_id where bucket in ('exact', 'initials', 'surname')),
 nm as (select k, min_by(canonical_id, source_name) id, min_by(canonical_name, source_name) cn, min_by(method, source_name) me from (select *, {NAME_KEY("source_name")} k from mp) where k <> '' group by 1)"""
RESOLVE_SQL = """coalesce(case when trim({0}) = '' then 'NA' end, e.canonical_id, z.id, 'UNRESOLVED')"""
IDS_SQL = f"""{MAP_SQL}, nn as (select distinct n from (select batter n from pop union all select bowler from pop)),
 ni as (select n, case when coalesce(trim(n), '') = '' then 'NA' else coalesce(e.canonical_id, z.id, 'UNRESOLVED') end id from nn left join mp e on e.source_name = trim(n) left join nm z on z.k = {NAME_KEY("n")} and z.k <> ''),
 rf as (select pop.*, b.id batter_id, w.id bowler_id from pop left join ni b on b.n = pop.batter left join ni w on w.n = pop.bowler)"""
PART = DIMENSION_SQL["s20_participation"]
SQL = {
    "e06_mapping": f"with {MAP_SQL} select * from mp",
    "s13_resolved": f"""with {MAP_SQL}, d as (select distinct delivery_key, batter from deliveries), n as (select batter, count(*) balls from d group by 1)
        select batter, balls, case when coalesce(trim(batter), '') = '' then 'NA' else coalesce(e.canonical_id, z.id, 'UNRESOLVED') end batter_canonical_id,
        case when coalesce(trim(batter), '') = '' then 'NA' else coalesce(e.canonical_name, z.cn, trim(batter)) end batter_canonical_name,
        case when coalesce(trim(batter), '') = '' then 'none' else coalesce(e.method, z.me || '_normalized', 'unresolved') end batter_mapping_method
        from n left join mp e on e.source_name = trim(batter) left join nm z on z.k = {NAME_KEY("batter")} and z.k <> ''""",
    "pred05_resolved_batting": f"""with {FACT_SQL}, {IDS_SQL} select batter_id player_id, start_year, count(distinct batter) n_spellings, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls
        from rf where batter_id not in ('UNRESOLVED', 'NA') group by 1, 2""",
    "pred14_population": f"""with {FACT_SQL}, {IDS_SQL} select f.competition, count(*) n_rows, count(*) filter (start_year between 2018 and 2026 and not coalesce(is_super_over, false)) n_seasons,
        count(*) filter (start_year between 2018 and 2026 and not coalesce(is_super_over, false) and gender = 'male') n_gender,
        coalesce(max((select count(*) from rf where rf.competition = f.competition and batter_id not in ('UNRESOLVED', 'NA'))), 0)::bigint n_resolved from fact f group by 1""",
    "a09_collapsed": f"""with {MAP_SQL} select canonical_id player_id, min(canonical_name) player_name, count(distinct source_name) n_source_names, string_agg(distinct source_name, '|' order by source_name) source_names,
        string_agg(distinct method, '|' order by method) mapping_methods, case when bool_or(confidence = 'exact') then 'exact' else 'medium' end mapping_confidence from mp group by 1""",
    "y11_names": f"""with {FACT_SQL}, {IDS_SQL}, u as (select player_id, player_name, 0 p from people_register union select batter_id, batter, 1 from rf union select bowler_id, bowler, 2 from rf)
        select player_id, min_by(player_name, (p, player_name)) player_name from u where player_id not in ('UNRESOLVED', 'NA') group by 1""",
    "e11_evidence": f"""with pa as ({PART}), s as (select distinct player as name, concat_ws(' ', team, season) ts from pa where player is not null and team is not null and season is not null)
        select name, count(*)::integer n_team_seasons, string_agg(ts, '|' order by ts) team_seasons from s group by 1""",
    "e11_reference_names": f"with pa as ({PART}) select player_name as name from people_register where player_name is not null union select full_name from people_register where full_name is not null union select player from pa where player is not null",
    "u08_reconciliation": f"""with au as ({AUDIT}) select bucket, count(*) n_names, (select count(*) from (select name from au group by 1 having count(distinct bucket) > 1)) n_overlaps,
        (select count(distinct name) from au) n_observed from au group by 1""",
    "pred06_key_players": f"with {OBS_SQL} select name, batter, bowler from ob where regexp_matches(name, '(?i)sharma|kohli|praiprod|dhoni')",
    "j21_newcomers": f"""with {FACT_SQL}, {IDS_SQL}, s as (select batter_id p from rf where competition = 'ipl' union select bowler_id from rf where competition = 'ipl')
        select distinct player_id, player_id in (select p from s where p is not null) in_main from people_register""",
}
