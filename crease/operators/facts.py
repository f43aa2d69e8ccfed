"""The delivery fact: one row for each delivery key, with its flags, phase, season and competition.

Late and repeated rows count once. Two notions of legality are kept apart: ``legal_delivery`` (no wide; the balls a
batter faced) and ``is_legal_ball`` (neither wide nor no-ball; the balls a bowler bowled).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.functions.scalars import credited, name_key, safe_div, season_years
from crease.sources.tables import once, table

FIRST_SEASON, LAST_SEASON = 2018, 2026

MATCH_COLUMNS = ("match_id", "competition", "season", "gender", "match_date", "venue", "city", "team_1", "team_2", "toss_winner", "toss_decision", "outcome_winner", "scheduled_overs", "players_json")
DELIVERY_COLUMNS = (
    "delivery_key", "match_id", "innings_number", "innings_team", "is_super_over", "over_number", "delivery_in_over", "legal_ball_number", "is_legal_ball", "batter", "bowler", "non_striker",
    "batter_runs", "extra_runs", "total_runs", "byes_runs", "legbyes_runs", "noballs_runs", "penalty_runs", "wides_runs", "dismissal_count", "dismissal_type", "dismissal_player_out",
)


def phase(over: Column, zero_based: Column) -> Column:
    """Powerplay, Middle or Death of an over number; 'Unknown' when it is NULL. The base decides the cut points."""
    first, second = F.when(zero_based, 5).otherwise(6), F.when(zero_based, 14).otherwise(15)
    return F.when(over.isNull(), "Unknown").when(over <= first, "Powerplay").when(over <= second, "Middle").otherwise("Death")


def matches(spark: SparkSession, base: str) -> DataFrame:
    m = table(spark, base, "matches").select(*MATCH_COLUMNS).dropDuplicates(["match_id"])
    return m.withColumn("start_year", season_years(F.col("season"))[0])


def fact(spark: SparkSession, base: str) -> DataFrame:
    """The delivery fact of the tables below ``base``, made once for a session and read by every query after that."""
    return once(spark, "fact", table(spark, base, "deliveries"), lambda: build_fact(spark, base))


def build_fact(spark: SparkSession, base: str) -> DataFrame:
    # One shuffle by match serves the removal of repeats (a delivery's key holds its match), the join and the layout.
    d = table(spark, base, "deliveries").select(*DELIVERY_COLUMNS).where("match_id is not null")
    d = d.repartition("match_id").dropDuplicates(["match_id", "delivery_key"])
    first = table(spark, base, "deliveries").agg((F.min("over_number") == 0).alias("zero_based"))
    m = matches(spark, base).select("match_id", "competition", "start_year", "gender", "venue", "city", "match_date")
    flag = lambda c: c.cast("int")
    legal = F.coalesce(F.col("wides_runs"), F.lit(0)) == 0
    rows = d.join(m, "match_id").crossJoin(F.broadcast(first))
    return rows.withColumns({
        "legal_delivery": flag(legal),
        "is_four": flag(F.col("batter_runs") == 4),
        "is_six": flag(F.col("batter_runs") == 6),
        "is_dot": flag((F.col("batter_runs") == 0) & legal),
        "is_wicket": flag(F.coalesce(F.col("dismissal_count"), F.lit(0)) > 0),
        "is_credited": flag(credited(F.col("dismissal_type"))),
        "conceded": F.col("total_runs") - F.coalesce(F.col("byes_runs"), F.lit(0)) - F.coalesce(F.col("legbyes_runs"), F.lit(0)),
        "bowler_ball": flag(F.coalesce(F.col("is_legal_ball"), F.lit(False))),
        "phase": phase(F.col("over_number"), F.col("zero_based")),
    }).drop("zero_based")


def population(rows: DataFrame, gender: str | None = "male", first: int = FIRST_SEASON, last: int = LAST_SEASON) -> DataFrame:
    """The standard population: seasons from first to last, no super overs, one gender (None: all)."""
    rows = rows.where(F.col("start_year").between(first, last) & ~F.coalesce(F.col("is_super_over"), F.lit(False)))
    return rows if gender is None else rows.where(F.col("gender") == gender)


def with_scopes(rows: DataFrame) -> DataFrame:
    """Each row once for all leagues and once more for the main league, tagged ``scope``; one pass over the data."""
    scopes = F.when(F.col("competition") == "ipl", F.array(F.lit("all"), F.lit("ipl"))).otherwise(F.array(F.lit("all")))
    return rows.withColumn("scope", F.explode(scopes))


def identities(names: DataFrame, register: DataFrame, column: str) -> DataFrame:
    """names + player_id and method: the exact register name, else its normalised form, else UNRESOLVED (blank: NA)."""
    known = register.select("player_id", "player_name").distinct()
    exact = known.groupBy(F.col("player_name").alias(column)).agg(F.min("player_id").alias("exact_id"))
    normal = known.groupBy(name_key(F.col("player_name")).alias("key")).agg(F.min("player_id").alias("normal_id"))
    rows = names.withColumn("key", name_key(F.col(column))).join(exact, column, "left").join(normal, "key", "left")
    blank = F.coalesce(F.trim(column), F.lit("")) == ""
    method = F.when(blank, "blank").when(F.col("exact_id").isNotNull(), "exact").when(F.col("normal_id").isNotNull(), "normalised").otherwise("unresolved")
    player = F.when(blank, "NA").otherwise(F.coalesce("exact_id", "normal_id", F.lit("UNRESOLVED")))
    return rows.withColumns({"player_id": player, "method": method}).drop("key", "exact_id", "normal_id")


def pct(num: Column, den: Column) -> Column:
    return F.round(100 * safe_div(num, den), 4)


def long(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


FACT_SQL = """
m as (select distinct match_id, competition, season, gender, match_date, venue, city, team_1, team_2, toss_winner, toss_decision, outcome_winner, scheduled_overs, players_json,
        try_cast(nullif(regexp_extract(season, '((?:19|20)[0-9]{2})', 1), '') as integer) start_year from matches),
d as (select distinct delivery_key, match_id, innings_number, innings_team, is_super_over, over_number, delivery_in_over, legal_ball_number, is_legal_ball, batter, bowler, non_striker, batter_runs, extra_runs,
        total_runs, byes_runs, legbyes_runs, noballs_runs, penalty_runs, wides_runs, dismissal_count, dismissal_type, dismissal_player_out from deliveries),
zb as (select min(over_number) = 0 z from deliveries),
fact as (select d.*, m.competition, m.start_year, m.gender, m.venue, m.match_date,
        (coalesce(wides_runs, 0) = 0)::int legal_delivery, (batter_runs = 4)::int is_four, (batter_runs = 6)::int is_six, (batter_runs = 0 and coalesce(wides_runs, 0) = 0)::int is_dot,
        (coalesce(dismissal_count, 0) > 0)::int is_wicket,
        coalesce(len(list_filter(list_transform(string_split(dismissal_type, '|'), lambda x: lower(trim(x))), lambda x: x <> '' and x not in ('run out', 'retired hurt', 'retired out', 'retired not out', 'obstructing the field'))) > 0, false)::int is_credited,
        total_runs - coalesce(byes_runs, 0) - coalesce(legbyes_runs, 0) conceded, coalesce(is_legal_ball, false)::int bowler_ball,
        case when over_number is null then 'Unknown' when over_number <= case when zb.z then 5 else 6 end then 'Powerplay' when over_number <= case when zb.z then 14 else 15 end then 'Middle' else 'Death' end phase
        from d join m using (match_id) cross join zb),
pop as (select * from fact where start_year between 2018 and 2026 and not coalesce(is_super_over, false) and gender = 'male'),
scoped as (select *, unnest(case when competition = 'ipl' then ['all', 'ipl'] else ['all'] end) as scope from pop)
"""


def sql(body: str) -> str:
    return f"with {FACT_SQL.strip()}{body.strip() if body.strip().startswith(',') else ' ' + body.strip()}"


def f01_flags(spark: SparkSession, base: str) -> DataFrame:
    return fact(spark, base).groupBy("competition", "phase").agg(
        F.count("*").alias("n_rows"), long(F.col("legal_delivery")).alias("legal_deliveries"), long(F.col("bowler_ball")).alias("legal_balls"), long(F.col("is_four")).alias("fours"),
        long(F.col("is_six")).alias("sixes"), long(F.col("is_dot")).alias("dots"), long(F.col("is_wicket")).alias("wickets"), long(F.col("is_credited")).alias("credited"), long(F.col("conceded")).alias("conceded"),
    )


def f02_identity(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "deliveries").select("delivery_key", "batter").dropDuplicates(["delivery_key"])
    names = d.groupBy("batter").agg(F.count("*").alias("balls"))
    return identities(names, table(spark, base, "people_register"), "batter").select("batter", "balls", "player_id", "method")


def f18_environment(spark: SparkSession, base: str) -> DataFrame:
    rows = population(fact(spark, base), gender=None)
    runs, balls, wkts = long(F.col("total_runs")), long(F.col("legal_delivery")), long(F.col("is_wicket"))
    return rows.groupBy("competition").agg(
        F.count_distinct("match_id").alias("matches"), F.count_distinct("start_year").alias("seasons"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"),
        runs.alias("runs"), balls.alias("balls"), wkts.alias("wickets"),
        F.round(6 * safe_div(runs, balls), 4).alias("run_rate"), pct(long(F.col("is_four") + F.col("is_six")), balls).alias("boundary_pct"), pct(long(F.col("is_dot")), balls).alias("dot_pct"),
        pct(wkts, balls).alias("wickets_per_100"), F.round(safe_div(balls, wkts, None), 4).alias("balls_per_wicket"),
    )


QUERIES = {"f01_flags": f01_flags, "f02_identity": f02_identity, "f18_environment": f18_environment}

SQL = {
    "f01_flags": sql("""select competition, phase, count(*) n_rows, sum(legal_delivery)::bigint legal_deliveries, sum(bowler_ball)::bigint legal_balls, sum(is_four)::bigint fours, sum(is_six)::bigint sixes,
        sum(is_dot)::bigint dots, sum(is_wicket)::bigint wickets, sum(is_credited)::bigint credited, sum(conceded)::bigint conceded from fact group by 1, 2"""),
    "f02_identity": """with d as (select distinct delivery_key, batter from deliveries), n as (select batter, count(*) balls from d group by 1),
        k as (select distinct player_id, player_name, trim(regexp_replace(regexp_replace(lower(trim(player_name)), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) k from people_register),
        e as (select player_name, min(player_id) id from k group by 1), z as (select k, min(player_id) id from k group by 1),
        j as (select n.*, e.id eid, z.id zid, coalesce(trim(n.batter), '') = '' b from n left join e on e.player_name = n.batter
            left join z on z.k = trim(regexp_replace(regexp_replace(lower(trim(n.batter)), '[^\\p{L}\\p{M}\\p{N}_ ]', '', 'g'), ' +', ' ', 'g')))
        select batter, balls, case when b then 'NA' else coalesce(eid, zid, 'UNRESOLVED') end player_id,
        case when b then 'blank' when eid is not null then 'exact' when zid is not null then 'normalised' else 'unresolved' end as method from j""",
    "f18_environment": sql("""select competition, count(distinct match_id) matches, count(distinct start_year) seasons, min(match_date) first_date, max(match_date) last_date, sum(total_runs)::bigint runs,
        sum(legal_delivery)::bigint balls, sum(is_wicket)::bigint wickets, round(case when sum(legal_delivery) > 0 then 6 * (sum(total_runs) / sum(legal_delivery)) else 0 end, 4) run_rate,
        round(100 * (sum(is_four + is_six) / sum(legal_delivery)), 4) boundary_pct, round(100 * (sum(is_dot) / sum(legal_delivery)), 4) dot_pct, round(100 * (sum(is_wicket) / sum(legal_delivery)), 4) wickets_per_100,
        round(sum(legal_delivery) / nullif(sum(is_wicket), 0), 4) balls_per_wicket
        from fact where start_year between 2018 and 2026 and not coalesce(is_super_over, false) group by 1"""),
}
