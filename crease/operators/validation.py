"""Contracts and checks of the tables: columns and types, row rules, order, capacity, plausible bands, leakage.

A rule is a boolean column; a row breaks it where the column is false (NULL is not broken, as a missing operand says
nothing). All rules of a table are one aggregate over one scan. Reports are (rule, n_violations, n_rows); ``enforce``
raises where a report has violations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.errors import ContractError, LeakageError, QualityError
from crease.functions.lookups import is_subset
from crease.operators.auction import SALES_SQL, TRAIN_TO, VALID_TO, rupees
from crease.operators.dimensions import violations
from crease.operators.facts import FACT_SQL, fact, long, population
from crease.operators.features import SQL as FEATURE_SQL
from crease.operators.features import batting, innings, scoped
from crease.operators.leagues import SQL as LEAGUE_QUERIES
from crease.operators.leagues import recent_form
from crease.operators.nested import complete, has, members, objects
from crease.sources.tables import table

# The columns of the two normalised tables by type.
MATCH_TEXTS = (
    "match_id source_match_id competition source_path meta_data_version meta_created match_date dates_json season gender match_type team_type city venue "
    "team_1 team_2 teams_json event_json officials_json outcome_winner outcome_type outcome_margin_unit outcome_json toss_winner toss_decision "
    "player_of_match_json players_json registry_people_json missing_json supersubs_json innings_metadata_json"
).split()
MATCH_NUMBERS = "meta_revision balls_per_over scheduled_overs outcome_margin_value innings_count super_over_innings_count".split()
DELIVERY_TEXTS = (
    "delivery_key match_id source_match_id competition source_path season innings_team actual_delivery batter bowler non_striker dismissal_type "
    "dismissal_player_out wickets_json extras_json review_json replacements_json"
).split()
DELIVERY_NUMBERS = (
    "innings_number over_number delivery_in_over ball_in_over legal_ball_number batter_runs extra_runs total_runs byes_runs legbyes_runs noballs_runs "
    "penalty_runs wides_runs dismissal_count"
).split()
MATCH_TYPES = dict.fromkeys(MATCH_TEXTS, "string") | dict.fromkeys(MATCH_NUMBERS, "bigint")
DELIVERY_TYPES = dict.fromkeys(DELIVERY_TEXTS, "string") | dict.fromkeys(DELIVERY_NUMBERS, "bigint") | {"is_super_over": "boolean", "is_legal_ball": "boolean"}
RUNS = ("batter_runs", "extra_runs", "total_runs", "byes_runs", "legbyes_runs", "noballs_runs", "penalty_runs", "wides_runs")
EXTRAS = {"byes": "byes_runs", "legbyes": "legbyes_runs", "noballs": "noballs_runs", "penalty": "penalty_runs", "wides": "wides_runs"}
# What the consolidated auction records may hold ('' is missing).
NATIONALITIES, CAPPED, CURRENCIES = ("", "Indian", "Overseas"), ("", "Capped", "Uncapped"), ("", "INR", "USD")
ROLES = ("", "Batsman", "Batter", "Bowler", "All-Rounder", "All Rounder", "Wicket-Keeper", "Wicket Keeper")
AUCTION_COLUMNS = (
    "year", "player_name", "nationality", "role", "capped_status", "base_price", "base_price_currency", "sold_price", "sold_price_currency", "team_name", "source_file",
)


def schema_problems(df: DataFrame, types: dict[str, str], beside: Iterable[str] = ("loaded_at",)) -> list[str]:
    """What is wrong with the columns of ``df``: absent ones, others than named, and other types."""
    have = dict(df.dtypes)
    found = [f"missing column {c}" for c in types if c not in have]
    found += [f"unexpected column {c}" for c in have if c not in types and c not in beside]
    return found + [f"{c} is {have[c]}, not {t}" for c, t in types.items() if c in have and have[c] != t]


def require_schema(df: DataFrame, types: dict[str, str], beside: Iterable[str] = ("loaded_at",)) -> DataFrame:
    found = schema_problems(df, types, beside)
    if found:
        raise ContractError("; ".join(found))
    return df


def enforce(report: DataFrame, error: type[QualityError] = QualityError) -> DataFrame:
    """The report, or the error with the broken rules. A report has a row for each rule, so it is small."""
    broken = report.where("n_violations > 0").collect()
    if broken:
        raise error("; ".join(f"{r['rule']}: {r['n_violations']} of {r['n_rows']}" for r in broken))
    return report


def decodes(c: str) -> Column:
    """Whether a text is JSON (NULL for NULL)."""
    return F.when(F.col(c).isNotNull(), F.try_parse_json(c).isNotNull())


def occurs_once(df: DataFrame, key: str, rule: str) -> DataFrame:
    keys = df.groupBy(key).agg(F.count("*").alias("n"))
    broken = F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("n_violations")
    return keys.agg(F.lit(rule).alias("rule"), broken, F.count("*").alias("n_rows"))


def match_rules() -> dict[str, Column]:
    c = F.col
    return {
        "keys are present": c("match_id").isNotNull() & c("source_match_id").isNotNull() & c("competition").isNotNull() & c("source_path").isNotNull(),
        "key has its parts": c("match_id") == F.concat_ws(":", "competition", "source_match_id"),
        "path names the competition": F.regexp_extract("source_path", r"([^/]+)/[^/]+\.json$", 1) == c("competition"),
        "balls per over positive": c("balls_per_over") > 0,
        "scheduled overs positive": c("scheduled_overs") > 0,
        "innings count positive": c("innings_count") > 0,
        "super overs within innings": (c("super_over_innings_count") >= 0) & (c("super_over_innings_count") <= c("innings_count")),
        "margin not negative": c("outcome_margin_value") >= 0,
        **{f"{x} is JSON": decodes(x) for x in ("dates_json", "teams_json", "players_json", "registry_people_json", "innings_metadata_json", "outcome_json")},
    }


def matches_report(spark: SparkSession, base: str) -> DataFrame:
    """All rules of the matches in one scan, and that a match occurs once (late copies of a row count once)."""
    m = require_schema(table(spark, base, "matches"), MATCH_TYPES).drop("loaded_at").distinct()
    return violations(m, match_rules()).unionByName(occurs_once(m, "match_id", "match occurs once"))


def delivery_rules() -> dict[str, Column]:
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0))
    extras = F.from_json("extras_json", "map<string,bigint>")
    legal = F.coalesce(c("is_legal_ball"), F.lit(False))
    required = ("delivery_key", "match_id", "source_match_id", "competition", "source_path", "batter", "bowler", "non_striker", "innings_number", "over_number", "delivery_in_over")
    present = F.lit(True)
    for x in required:
        present = present & c(x).isNotNull()
    return {
        "required fields present": present,
        "key has its parts": c("delivery_key") == F.concat_ws(":", "match_id", "innings_number", "over_number", "delivery_in_over"),
        "path names the competition": F.regexp_extract("source_path", r"([^/]+)/[^/]+\.json$", 1) == c("competition"),
        "innings number from 1": c("innings_number") >= 1, "over number from 0": c("over_number") >= 0, "place in over from 1": c("delivery_in_over") >= 1,
        "ball in over positive": c("ball_in_over") > 0, "dismissals not negative": c("dismissal_count") >= 0,
        "runs not negative": F.least(*[zero(x) for x in RUNS]) >= 0,
        "total is bat plus extras": c("total_runs") == c("batter_runs") + c("extra_runs"),
        "legal ball has no wide or no-ball": c("is_legal_ball") == ((zero("wides_runs") == 0) & (zero("noballs_runs") == 0)),
        "legal ball has a number": ~legal | c("legal_ball_number").isNotNull(), "other ball has none": legal | c("legal_ball_number").isNull(),
        "legal number positive": c("legal_ball_number") > 0,
        **{f"{x} is JSON": decodes(x) for x in ("wickets_json", "extras_json", "review_json", "replacements_json")},
        "dismissals as in wickets": F.json_array_length("wickets_json") == c("dismissal_count"),
        **{f"{col} as in extras": F.when(extras.isNotNull(), F.coalesce(F.try_element_at(extras, F.lit(k)), F.lit(0)) == zero(col)) for k, col in EXTRAS.items()},
    }


def deliveries_report(spark: SparkSession, base: str) -> DataFrame:
    d = require_schema(table(spark, base, "deliveries"), DELIVERY_TYPES).drop("loaded_at").distinct()
    return violations(d, delivery_rules()).unionByName(occurs_once(d, "delivery_key", "delivery occurs once"))


def innings_objects(spark: SparkSession, base: str) -> DataFrame:
    """(match_id, innings_number, x): the members of each innings' object, whatever shape the text has."""
    m = table(spark, base, "matches").select("match_id", complete(F.col("innings_metadata_json")).alias("i")).distinct()
    wrapped = F.when(F.col("i").startswith("{"), has(members(F.col("i")), "innings"))
    rows = m.select("match_id", F.posexplode(objects(F.coalesce(wrapped, F.col("i")))).alias("p", "x"))
    return rows.select("match_id", (F.col("p") + 1).cast("bigint").alias("innings_number"), "x")


def over_balls(spark: SparkSession, base: str) -> DataFrame:
    """Each over with its legal balls, how many it should have (a miscounted over says so itself), and whether it holds
    more than that or lies outside the scheduled overs."""
    d = table(spark, base, "deliveries").select("delivery_key", "match_id", "innings_number", "over_number", "is_legal_ball").dropDuplicates(["delivery_key"])
    overs = d.groupBy("match_id", "innings_number", "over_number").agg(F.count_if(F.coalesce("is_legal_ball", F.lit(False))).alias("n_legal"))
    m = table(spark, base, "matches").select("match_id", "balls_per_over", "scheduled_overs").distinct()
    rows = overs.join(m, "match_id").join(innings_objects(spark, base), ["match_id", "innings_number"], "left")
    told = has(members(has(members(has(F.col("x"), "miscounted_overs")), F.col("over_number").cast("string"))), "balls").try_cast("bigint")
    expected = F.coalesce(told, F.col("balls_per_over"))
    outside = (F.col("over_number") < 0) | (F.col("over_number") >= F.col("scheduled_overs"))
    return rows.select(
        "match_id", "innings_number", "over_number", "n_legal", expected.alias("expected_balls"), F.coalesce(F.col("n_legal") > expected, F.lit(False)).alias("over_capacity"),
        F.coalesce(outside, F.lit(False)).alias("outside_schedule"),
    )


def cross_report(spark: SparkSession, base: str) -> DataFrame:
    """Rules across the tables: known matches, innings within the match, super overs as the metadata says, legal balls
    numbered 1, 2, ... by place, and the order of keys by place."""
    d = table(spark, base, "deliveries").drop("loaded_at").dropDuplicates(["delivery_key"])
    m = table(spark, base, "matches").select("match_id", "innings_count").distinct()
    known = d.select("match_id").join(m.withColumn("there", F.lit(True)), "match_id", "left")
    out = violations(known, {"match is known": F.coalesce("there", F.lit(False))})
    counts = d.join(m, "match_id").select("innings_number", "innings_count")
    out = out.unionByName(violations(counts, {"innings within the match": F.col("innings_number") <= F.col("innings_count")}))
    told = innings_objects(spark, base).select("match_id", "innings_number", (F.lower(F.coalesce(has(F.col("x"), "super_over"), F.lit("false"))) == "true").alias("told"))
    supers = d.select("match_id", "innings_number", "is_super_over").join(told, ["match_id", "innings_number"])
    out = out.unionByName(violations(supers, {"super over as in metadata": F.col("is_super_over") == F.col("told")}))
    place = Window.partitionBy("match_id", "innings_number").orderBy("over_number", "delivery_in_over")
    numbered = d.where("is_legal_ball").withColumn("k", F.row_number().over(place))
    out = out.unionByName(violations(numbered, {"legal balls are numbered in order": F.col("legal_ball_number") == F.col("k")}))
    # A table has no order of rows; that a sort by place is one of keys is that no two rows share a place.
    places = d.groupBy("match_id", "innings_number", "over_number", "delivery_in_over").agg(F.count("*").alias("n"))
    return out.unionByName(violations(places, {"places are distinct": F.col("n") == 1}))


def subset_report(spark: SparkSession, base: str) -> DataFrame:
    """Whether the matches of the deliveries, and the people the documents are about, are among those listed."""
    d, m = table(spark, base, "deliveries"), table(spark, base, "matches")
    p = table(spark, base, "documents").where("player_id is not null")
    rows = is_subset(d, m, ["match_id"]).withColumn("what", F.lit("matches of deliveries"))
    return rows.unionByName(is_subset(p, table(spark, base, "people_register"), ["player_id"]).withColumn("what", F.lit("people of documents")))


def auction_records(spark: SparkSession, base: str) -> DataFrame:
    """The lots as the eleven text columns of the consolidated record; '' is missing."""
    lots = table(spark, base, "auction_lots").drop("loaded_at").dropDuplicates(["lot_id"])
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^0-9.]", "")
    sold = F.coalesce(*[F.nullif(digits(c), F.lit("")) for c in ("winning_bid_in_rs", "price_in_rs", "price_in_usd")], F.lit(""))
    rupee = F.coalesce(F.nullif(digits("winning_bid_in_rs"), F.lit("")), F.nullif(digits("price_in_rs"), F.lit(""))).isNotNull()
    based = digits("base_prices_in_rs")
    return lots.select(
        F.coalesce(F.col("auction_year").cast("string"), F.lit("")).alias("year"), text("name_raw").alias("player_name"), text("nationality").alias("nationality"), text("role_raw").alias("role"),
        text("capped_uncapped").alias("capped_status"), based.alias("base_price"), F.when(based != "", "INR").otherwise("").alias("base_price_currency"), sold.alias("sold_price"),
        F.when(rupee, "INR").when(sold != "", "USD").otherwise("").alias("sold_price_currency"), text("team_name").alias("team_name"), text("source_file").alias("source_file"),
    )


def auction_rules() -> dict[str, Column]:
    c = F.col
    year = c("year").try_cast("bigint")
    number = lambda x: (c(x) == "") | c(x).try_cast("double").isNotNull()
    rules = {f"{x} not empty": c(x) != "" for x in ("year", "player_name", "team_name", "source_file", "sold_price")}
    rules |= {"year is a number": year.isNotNull(), "year in range": year.between(2013, 2100)}
    allowed = {"nationality": NATIONALITIES, "capped_status": CAPPED, "role": ROLES, "base_price_currency": CURRENCIES, "sold_price_currency": CURRENCIES}
    rules |= {f"{x} is allowed": c(x).isin(*values) for x, values in allowed.items()}
    for x in ("base_price", "sold_price"):
        rules |= {f"{x} is a number": number(x), f"{x} not negative": c(x).try_cast("double") >= 0, f"{x} has a currency": (c(x) == "") | (c(f"{x}_currency") != "")}
    return rules


def auction_contract(records: DataFrame) -> DataFrame:
    """All rules of consolidated auction records, and that a record (year, player, team, file) occurs once."""
    require_schema(records, dict.fromkeys(AUCTION_COLUMNS, "string"))
    groups = records.groupBy("year", "player_name", "team_name", "source_file").agg(F.count("*").alias("n"))
    repeated = groups.agg(F.lit("record occurs once").alias("rule"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)), F.lit(0)).alias("n_violations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return violations(records, auction_rules()).unionByName(repeated)


def auction_report(spark: SparkSession, base: str) -> DataFrame:
    return auction_contract(auction_records(spark, base))


def leakage_report(spark: SparkSession, base: str) -> DataFrame:
    """Nothing of the future among the features: the split by years, the seasons before a season, the domestic slice."""
    years = rupees(spark, base).select("year", F.when(F.col("year") <= TRAIN_TO, "train").when(F.col("year") <= VALID_TO, "valid").alias("part"))
    split = years.agg(F.max(F.when(F.col("part") == "train", F.col("year"))).alias("a"), F.min(F.when(F.col("part") == "valid", F.col("year"))).alias("b"))
    out = violations(split, {"train before validation": F.col("a") < F.col("b")})
    form = recent_form(spark, base)
    first = form.groupBy("player").agg(F.min("start_year").alias("first"))
    prior = form.join(first, "player").where(F.col("start_year") == F.col("first"))
    out = out.unionByName(violations(prior, {"first season has no form": F.col("prior_balls") == 0}))
    domestic = population(fact(spark, base)).where("competition = 'sma'")
    return out.unionByName(violations(domestic, {"no main league in the domestic slice": F.col("competition") != "ipl"}))


def bands(spark: SparkSession, base: str) -> DataFrame:
    """Measures of all rows against the bands in which they are plausible: metric, value, low, high, is_within."""
    rows = population(fact(spark, base), gender=None)
    runs, balls, legal, wickets = (long(F.col(c)) for c in ("total_runs", "legal_delivery", "bowler_ball", "is_wicket"))
    one = rows.agg(runs.alias("r"), balls.alias("b"), legal.alias("l"), wickets.alias("w"))
    guarded = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    values = {"run_rate": (6 * guarded("r", "b"), 7.0, 9.5), "balls_per_wicket": (guarded("b", "w"), 15.0, 26.0), "wicket_pct": (100 * guarded("w", "l"), 1.0, 15.0)}
    made = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, 4).alias("value"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for k, (v, lo, hi) in values.items()])
    return one.select(F.inline(made)).select("metric", "value", "low", "high", F.coalesce(F.col("value").between(F.col("low"), F.col("high")), F.lit(False)).alias("is_within"))


def skew_check(spark: SparkSession, base: str, min_innings: int = 4) -> DataFrame:
    """Scores are skewed to the right: among batters with enough innings, how many have a mean above their median."""
    i = innings(scoped(spark, base).where("scope = 'all'"))
    g = i.groupBy("player").agg(F.avg("runs").alias("mean"), F.percentile("runs", F.lit(0.5)).alias("median"), F.count("*").alias("n")).where(F.col("n") >= min_innings)
    right = F.count_if(F.col("mean") > F.col("median"))
    return g.agg(F.count("*").alias("n_batters"), right.alias("n_right_skewed")).withColumn("is_right_skewed", F.col("n_right_skewed") * 2 > F.col("n_batters"))


def dependency_check(spark: SparkSession, base: str) -> DataFrame:
    """The boundary dependency of every player season is a share; which also shows that its runs add up."""
    return violations(batting(spark, base), {"boundary dependency is a share": F.col("boundary_dependency").between(0, 1), "runs from boundaries at most all": 4 * F.col("fours") + 6 * F.col("sixes") <= F.col("runs")})


def run_all(spark: SparkSession, base: str) -> DataFrame:
    """Every report of rules in one table; ``enforce`` of it is the gate of a pipeline."""
    out = None
    for name, report in (("matches", matches_report), ("deliveries", deliveries_report), ("cross", cross_report), ("auction", auction_report), ("leakage", leakage_report)):
        rows = report(spark, base).withColumn("report", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def require_no_leakage(spark: SparkSession, base: str) -> DataFrame:
    return enforce(leakage_report(spark, base), LeakageError)


QUERIES = {
    "v02_matches": matches_report, "v03_deliveries": deliveries_report, "c04_over_balls": over_balls, "v04_cross": cross_report, "u07_subset": subset_report, "v07_auction": auction_report,
    "v09_leakage": leakage_report, "m07_bands": bands, "m04_skew": skew_check, "v08_dependency": dependency_check, "v06_all": run_all,
}


def report_sql(rows: str, rules: dict[str, str]) -> str:
    """SQL of a report: each rule is the condition of a broken row."""
    return " union all ".join(f"select '{k}' as rule, count(*) filter ({c}) n_violations, count(*) n_rows from {rows}" for k, c in rules.items())


JSON_MATCH = ("dates_json", "teams_json", "players_json", "registry_people_json", "innings_metadata_json", "outcome_json")
PATH = "regexp_extract(source_path, '([^/]+)/[^/]+[.]json$', 1) <> competition"
MATCH_SQL = report_sql("m", {
    "keys are present": "match_id is null or source_match_id is null or competition is null or source_path is null", "key has its parts": "match_id <> concat_ws(':', competition, source_match_id)",
    "path names the competition": PATH, "balls per over positive": "balls_per_over <= 0", "scheduled overs positive": "scheduled_overs <= 0", "innings count positive": "innings_count <= 0",
    "super overs within innings": "super_over_innings_count < 0 or super_over_innings_count > innings_count", "margin not negative": "outcome_margin_value < 0",
    **{f"{x} is JSON": f"{x} is not null and not json_valid({x})" for x in JSON_MATCH},
})
ONCE = "select '{0}' as rule, count(*) filter (n > 1) n_violations, count(*) n_rows from (select {1}, count(*) n from {2} group by 1)".format
ZERO = "coalesce({0}, 0)".format
EXTRA_SQL = {f"{c} as in extras": f"json_type(try_cast(extras_json as json)) = 'OBJECT' and coalesce(try_cast(json_extract_string(try_cast(extras_json as json), '$.{k}') as bigint), 0) <> {ZERO(c)}" for k, c in EXTRAS.items()}
DELIVERY_SQL = report_sql("d", {
    "required fields present": " or ".join(f"{x} is null" for x in ("delivery_key", "match_id", "source_match_id", "competition", "source_path", "batter", "bowler", "non_striker", "innings_number", "over_number", "delivery_in_over")),
    "key has its parts": "delivery_key <> concat_ws(':', match_id, innings_number, over_number, delivery_in_over)", "path names the competition": PATH,
    "innings number from 1": "innings_number < 1", "over number from 0": "over_number < 0", "place in over from 1": "delivery_in_over < 1", "ball in over positive": "ball_in_over <= 0",
    "dismissals not negative": "dismissal_count < 0", "runs not negative": f"least({', '.join(ZERO(x) for x in RUNS)}) < 0", "total is bat plus extras": "total_runs <> batter_runs + extra_runs",
    "legal ball has no wide or no-ball": "is_legal_ball <> (coalesce(wides_runs, 0) = 0 and coalesce(noballs_runs, 0) = 0)", "legal ball has a number": "is_legal_ball and legal_ball_number is null",
    "other ball has none": "not coalesce(is_legal_ball, false) and legal_ball_number is not null", "legal number positive": "legal_ball_number <= 0",
    **{f"{x} is JSON": f"{x} is not null and not json_valid({x})" for x in ("wickets_json", "extras_json", "review_json", "replacements_json")},
    "dismissals as in wickets": "json_type(try_cast(wickets_json as json)) = 'ARRAY' and json_array_length(try_cast(wickets_json as json)) <> dismissal_count", **EXTRA_SQL,
})
INNINGS_SQL = """mi as (select distinct match_id, case json_type(try_cast(innings_metadata_json as json)) when 'VARCHAR' then try_cast(json_extract_string(try_cast(innings_metadata_json as json), '$') as json)
   else try_cast(innings_metadata_json as json) end n from matches),
 ml as (select match_id, case when json_type(n) = 'OBJECT' and json_type(json_extract(n, '$.innings')) is not null then json_extract(n, '$.innings') else n end n from mi),
 io as (select match_id, unnest(cast(n as json[])) x, generate_subscripts(cast(n as json[]), 1) i from ml where json_type(n) = 'ARRAY')"""
AUCTION_SQL = """lo as (select distinct * exclude (loaded_at) from auction_lots), dg as (select *, regexp_replace(coalesce(winning_bid_in_rs, ''), '[^0-9.]', '', 'g') w, regexp_replace(coalesce(price_in_rs, ''), '[^0-9.]', '', 'g') r,
   regexp_replace(coalesce(price_in_usd, ''), '[^0-9.]', '', 'g') u, regexp_replace(coalesce(base_prices_in_rs, ''), '[^0-9.]', '', 'g') b from lo),
 re as (select coalesce(auction_year::varchar, '') as year, coalesce(trim(name_raw, ' '), '') player_name, coalesce(trim(nationality, ' '), '') nationality, coalesce(trim(role_raw, ' '), '') as role, coalesce(trim(capped_uncapped, ' '), '') capped_status,
   b base_price, case when b <> '' then 'INR' else '' end base_price_currency, coalesce(nullif(w, ''), nullif(r, ''), u) sold_price,
   case when w <> '' or r <> '' then 'INR' when u <> '' then 'USD' else '' end sold_price_currency, coalesce(trim(team_name, ' '), '') team_name, coalesce(trim(source_file, ' '), '') source_file from dg)"""
LIST = lambda values: ", ".join(f"'{v}'" for v in values)
AUCTION_RULES = {f"{x} not empty": f"\"{x}\" = ''" for x in ("year", "player_name", "team_name", "source_file", "sold_price")}
AUCTION_RULES |= {"year is a number": "try_cast(year as bigint) is null", "year in range": "not try_cast(year as bigint) between 2013 and 2100"}
AUCTION_RULES |= {f"{x} is allowed": f"\"{x}\" not in ({LIST(v)})" for x, v in (("nationality", NATIONALITIES), ("capped_status", CAPPED), ("role", ROLES), ("base_price_currency", CURRENCIES), ("sold_price_currency", CURRENCIES))}
for _x in ("base_price", "sold_price"):
    AUCTION_RULES |= {f"{_x} is a number": f"{_x} <> '' and try_cast({_x} as double) is null", f"{_x} not negative": f"try_cast({_x} as double) < 0", f"{_x} has a currency": f"{_x} <> '' and {_x}_currency = ''"}
POPULATION = "start_year between 2018 and 2026 and not coalesce(is_super_over, false)"
INNINGS_OF = FEATURE_SQL["f05_innings"].replace("with ", "", 1).rsplit("select * from inn", 1)[0]
SQL = {
    "v02_matches": f"with m as (select distinct * exclude (loaded_at) from matches) {MATCH_SQL} union all {ONCE('match occurs once', 'match_id', 'm')}",
    "v03_deliveries": f"with d as (select distinct * exclude (loaded_at) from deliveries) {DELIVERY_SQL} union all {ONCE('delivery occurs once', 'delivery_key', 'd')}",
    "c04_over_balls": f"""with {INNINGS_SQL}, d as (select distinct delivery_key, match_id, innings_number, over_number, is_legal_ball from deliveries),
        ov as (select match_id, innings_number, over_number, count(*) filter (is_legal_ball) n_legal from d group by all), m as (select distinct match_id, balls_per_over, scheduled_overs from matches),
        j as (select ov.*, scheduled_overs, coalesce(try_cast(json_extract_string(io.x, '$.miscounted_overs."' || over_number || '".balls') as bigint), balls_per_over) e
            from ov join m using (match_id) left join io on io.match_id = ov.match_id and io.i = ov.innings_number)
        select match_id, innings_number, over_number, n_legal, e expected_balls, coalesce(n_legal > e, false) over_capacity, coalesce(over_number < 0 or over_number >= scheduled_overs, false) outside_schedule from j""",
    "v04_cross": f"""with {INNINGS_SQL}, d as (select distinct * exclude (loaded_at) from deliveries), m as (select distinct match_id, innings_count from matches),
        lg as (select *, row_number() over (partition by match_id, innings_number order by over_number, delivery_in_over) k from d where is_legal_ball),
        su as (select is_super_over, lower(coalesce(json_extract_string(x, '$.super_over'), 'false')) = 'true' t from d join io on io.match_id = d.match_id and io.i = d.innings_number where json_type(x) = 'OBJECT')
        select 'match is known' as rule, count(*) filter (match_id not in (select match_id from m)) n_violations, count(*) n_rows from d
        union all select 'innings within the match', count(*) filter (innings_number > innings_count), count(*) from d join m using (match_id)
        union all select 'super over as in metadata', count(*) filter (is_super_over <> t), count(*) from su
        union all select 'legal balls are numbered in order', count(*) filter (legal_ball_number <> k), count(*) from lg
        union all select 'places are distinct', count(*) filter (n > 1), count(*) from (select count(*) n from d group by match_id, innings_number, over_number, delivery_in_over)""",
    "u07_subset": """select 'matches of deliveries' what, n n_missing, n = 0 is_subset from (select count(*) n from (select distinct match_id from deliveries where match_id not in (select match_id from matches)))
        union all select 'people of documents', n, n = 0 from (select count(*) n from (select distinct player_id from documents where player_id is not null and player_id not in (select player_id from people_register)))""",
    "v07_auction": f"""with {AUCTION_SQL} {report_sql("re", AUCTION_RULES)} union all select 'record occurs once', coalesce(sum(case when n > 1 then n else 0 end), 0)::bigint, coalesce(sum(n), 0)::bigint
        from (select count(*) n from re group by year, player_name, team_name, source_file)""",
    "m07_bands": f"""with {FACT_SQL}, o as (select sum(total_runs) r, sum(legal_delivery) b, sum(bowler_ball) l, sum(is_wicket) w from fact where {POPULATION}),
        v as (select 'run_rate' metric, round(6 * (r / b), 4) as value, 7.0::double low, 9.5::double high from o union all select 'balls_per_wicket', round(b / w, 4), 15, 26 from o union all select 'wicket_pct', round(100 * (w / l), 4), 1, 15 from o)
        select *, coalesce(value between low and high, false) is_within from v""",
    "m04_skew": f"""with {INNINGS_OF}, g as (select player, avg(runs) a, quantile_cont(runs, 0.5) m, count(*) n from inn where scope = 'all' group by 1 having count(*) >= 4)
        select count(*) n_batters, count(*) filter (a > m) n_right_skewed, count(*) filter (a > m) * 2 > count(*) is_right_skewed from g""",
    "v08_dependency": f"""with b as ({FEATURE_SQL['f06_season_batting']}) select 'boundary dependency is a share' as rule, count(*) filter (not boundary_dependency between 0 and 1) n_violations, count(*) n_rows from b
        union all select 'runs from boundaries at most all', count(*) filter (4 * fours + 6 * sixes > runs), count(*) from b""",
}
SQL["v09_leakage"] = f"""with {SALES_SQL}, y as (select max(year) filter (year <= {TRAIN_TO}) a, min(year) filter (year > {TRAIN_TO} and year <= {VALID_TO}) b from ru),
    fm as ({LEAGUE_QUERIES['j10_recent_form']}), ff as (select *, min(start_year) over (partition by player) f from fm), {FACT_SQL}
    select 'train before validation' as rule, count(*) filter (not a < b) n_violations, count(*) n_rows from y
    union all select 'first season has no form', count(*) filter (prior_balls <> 0), count(*) from ff where start_year = f
    union all select 'no main league in the domestic slice', 0, count(*) from pop where competition = 'sma'"""
_REPORTS = (("matches", "v02_matches"), ("deliveries", "v03_deliveries"), ("cross", "v04_cross"), ("auction", "v07_auction"), ("leakage", "v09_leakage"))
SQL["v06_all"] = " union all ".join(f"select *, '{name}' report from ({SQL[q]})" for name, q in _REPORTS)
