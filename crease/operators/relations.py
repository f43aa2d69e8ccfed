"""Relational breadth over the ball-by-ball tables: set operations, bridges, one-hot, latest rows, JSON checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.scalars import name_key
from crease.operators.facts import fact, long, population, sql
from crease.operators.features import SQL as FEATURE_SQL
from crease.operators.features import consistency
from crease.sources.tables import table


def union_missing(spark: SparkSession, base: str) -> DataFrame:
    """Season rows of batters and bowlers in one table, each side's own measures NULL on the other."""
    rows = population(fact(spark, base))
    bat = rows.groupBy(F.col("batter").alias("player"), "start_year").agg(long(F.col("batter_runs")).alias("runs_made")).withColumn("player_type", F.lit("batting"))
    bowl = rows.groupBy(F.col("bowler").alias("player"), "start_year").agg(long(F.col("conceded")).alias("runs_given")).withColumn("player_type", F.lit("bowling"))
    return bat.unionByName(bowl, allowMissingColumns=True).select("player", "start_year", "player_type", "runs_made", "runs_given")


def bridge(spark: SparkSession, base: str) -> DataFrame:
    """Typed names bridged to a registered id where the normalised name belongs to one person only."""
    r = table(spark, base, "people_register").select("player_id", F.explode(F.array("player_name", "full_name")).alias("n")).select("player_id", name_key(F.col("n")).alias("key"))
    one = r.groupBy("key").agg(F.count_distinct("player_id").alias("k"), F.min("player_id").alias("player_id")).where("k = 1").drop("k")
    names = table(spark, base, "manual_review").select("review_id", F.trim("source_name").alias("source_name")).dropDuplicates(["review_id"])
    return names.withColumn("key", name_key(F.col("source_name"))).join(one, "key").select("review_id", "source_name", "player_id")


def one_hot(spark: SparkSession, base: str) -> DataFrame:
    """Phases as indicator columns (the first level dropped; Unknown is all zero), summed by match."""
    rows = fact(spark, base)
    hot = [F.sum((F.col("phase") == p).cast("bigint")).alias(f"is_{p.lower()}") for p in ("Middle", "Powerplay")]
    return rows.groupBy("match_id").agg(F.count("*").alias("n_rows"), *hot)


def latest_badge(spark: SparkSession, base: str) -> DataFrame:
    """Each player's badge of the latest qualified season, else of the latest season."""
    c = consistency(spark, base).where("scope = 'all'")
    w = Window.partitionBy("player").orderBy((F.col("badge") == "Unqualified").cast("int"), F.desc("start_year"))
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("player", "start_year", "badge")


def usual_team(spark: SparkSession, base: str) -> DataFrame:
    """The team each batter batted for most often (ties by name), and the number of teams."""
    d = table(spark, base, "deliveries").select("delivery_key", "match_id", "innings_number", "batter", "innings_team").dropDuplicates(["delivery_key"])
    one = d.select("match_id", "innings_number", "batter", "innings_team").distinct()
    by = one.groupBy("batter", "innings_team").agg(F.count("*").alias("n"))
    return by.groupBy("batter").agg(F.min_by("innings_team", F.struct((-F.col("n")).alias("n"), "innings_team")).alias("usual_team"), F.count("*").alias("n_teams"), F.sum("n").alias("n_innings"))


def extras_check(spark: SparkSession, base: str) -> DataFrame:
    """Fields of the extras text against their columns: rows that agree, by field. An absent field is 0."""
    d = table(spark, base, "deliveries").select("delivery_key", "extras_json", "byes_runs", "legbyes_runs", "noballs_runs", "penalty_runs", "wides_runs").dropDuplicates(["delivery_key"])
    m = F.from_json("extras_json", "map<string,bigint>")
    kinds = ("byes", "legbyes", "noballs", "penalty", "wides")
    agree = [F.count_if(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).eqNullSafe(F.coalesce(F.col(f"{k}_runs"), F.lit(0)))).alias(k) for k in kinds]
    one = d.agg(F.count("*").alias("n_rows"), *agree)
    return one.selectExpr("n_rows", "stack(5, " + ", ".join(f"'{k}', {k}" for k in kinds) + ") as (field, n_agree)").select("field", "n_agree", "n_rows")


def common_opponents(spark: SparkSession, base: str) -> DataFrame:
    """Batters of the first innings and bowlers of the second as sets: in both (all-round), only batting, only bowling."""
    d = table(spark, base, "deliveries").where("innings_number <= 2").select("match_id", "innings_number", "batter", "bowler").distinct()
    bats = d.groupBy("match_id").agg(F.array_sort(F.collect_set(F.when(F.col("innings_number") == 1, F.col("batter")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("innings_number") == 2, F.col("bowler")))).alias("b"))
    return bats.select("match_id", F.size(F.array_intersect("a", "b")).alias("n_both"), F.size(F.array_except("a", "b")).alias("n_bat_only"), F.size(F.array_except("b", "a")).alias("n_bowl_only"))


def recent_matches(spark: SparkSession, base: str, keep: int = 3) -> DataFrame:
    """The last matches of each ground (a report of top rows; ties by match)."""
    m = table(spark, base, "matches").select("match_id", "venue", "match_date").dropDuplicates(["match_id"]).where("venue is not null")
    w = Window.partitionBy("venue").orderBy(F.desc("match_date"), "match_id")
    return m.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def rolled_up(spark: SparkSession, base: str) -> DataFrame:
    """Runs and balls by league and season, by league, and over all, in one pass (grouping sets)."""
    rows = population(fact(spark, base), gender=None)
    g = rows.rollup("competition", "start_year").agg(long(F.col("total_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"), F.grouping_id().cast("int").alias("level"))
    return g.select("competition", "start_year", "level", "runs", "balls")


QUERIES = {
    "u02_union_missing": union_missing, "j14_bridge": bridge, "pred21_one_hot": one_hot, "w07_latest_badge": latest_badge, "a07_usual_team": usual_team, "c07_extras_check": extras_check,
    "u05_common_opponents": common_opponents, "w08_recent_matches": recent_matches, "x01_rolled_up": rolled_up,
}


NK = "trim(regexp_replace(regexp_replace(lower(trim({0})), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))".format
SQL = {
    "u02_union_missing": sql("""select batter player, start_year, 'batting' player_type, sum(batter_runs)::bigint runs_made, null::bigint runs_given from pop group by all union all
        select bowler, start_year, 'bowling', null::bigint, sum(conceded)::bigint from pop group by all"""),
    "j14_bridge": f"""with r as (select player_id, {NK('unnest([player_name, full_name])')} k from people_register), o as (select k, min(player_id) player_id from r group by 1 having count(distinct player_id) = 1),
        n as (select distinct review_id, trim(source_name, ' ') source_name from manual_review) select review_id, source_name, player_id from n join o on o.k = {NK('source_name')}""",
    "pred21_one_hot": sql("select match_id, count(*) n_rows, sum((phase = 'Middle')::int)::bigint is_middle, sum((phase = 'Powerplay')::int)::bigint is_powerplay from fact group by 1"),
    "w07_latest_badge": f"""with c as ({FEATURE_SQL['f16_consistency']}) select player, start_year, badge from (select *, row_number() over (partition by player order by (badge = 'Unqualified')::int, start_year desc) k from c where scope = 'all') where k = 1""",
    "a07_usual_team": """with o as (select distinct match_id, innings_number, batter, innings_team from deliveries), b as (select batter, innings_team, count(*) n from o group by 1, 2)
        select batter, min_by(innings_team, (-n, innings_team)) usual_team, count(*) n_teams, sum(n)::bigint n_innings from b group by 1""",
    "c07_extras_check": "with d as (select distinct delivery_key, extras_json, byes_runs, legbyes_runs, noballs_runs, penalty_runs, wides_runs from deliveries) " + " union all ".join(
        f"select '{k}' field, count(*) filter (coalesce(try_cast(json_extract_string(extras_json, '$.{k}') as bigint), 0) = coalesce({k}_runs, 0)) n_agree, count(*) n_rows from d" for k in ("byes", "legbyes", "noballs", "penalty", "wides")),
    "u05_common_opponents": """with d as (select distinct match_id, innings_number, batter, bowler from deliveries where innings_number <= 2), a as (select distinct match_id, batter p from d where innings_number = 1), b as (select distinct match_id, bowler p from d where innings_number = 2),
        j as (select match_id, p, a.p is not null x, b.p is not null y from (select match_id, p from a union select match_id, p from b) u left join a using (match_id, p) left join b using (match_id, p))
        select match_id, (count(*) filter (x and y))::integer n_both, (count(*) filter (x and not y))::integer n_bat_only, (count(*) filter (y and not x))::integer n_bowl_only from j group by 1""",
    "w08_recent_matches": "with m as (select distinct match_id, venue, match_date from matches where venue is not null) select * from (select *, row_number() over (partition by venue order by match_date desc, match_id)::integer place from m) where place <= 3",
    "x01_rolled_up": sql("""select competition, start_year, (2 * grouping(competition) + grouping(start_year))::integer as level, sum(total_runs)::bigint runs, sum(legal_delivery)::bigint balls from fact
        where start_year between 2018 and 2026 and not coalesce(is_super_over, false) group by rollup (competition, start_year)"""),
}
