"""Season features of batters and bowlers, phases, spells, consistency and score distributions.

Every feature is one grouped pass over the scoped fact (all leagues and the main league at once). A dismissal is an
event: the batter out and the kind of each wicket on a ball, including a non-striker who never faced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.prefix import dense_ranks
from crease.functions.scalars import CENSORED_KINDS, safe_div
from crease.operators.facts import fact, long, pct, population, sql, with_scopes


def scoped(spark: SparkSession, base: str) -> DataFrame:
    return with_scopes(population(fact(spark, base)))


def dismissals(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each dismissal of a ball: keep, player, kind. Kinds are padded with the last one, or 'unknown'."""
    players = F.filter(F.transform(F.split("dismissal_player_out", r"\|"), F.trim), lambda x: x != "")
    kinds = F.filter(F.transform(F.split("dismissal_type", r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    out = rows.where("dismissal_player_out is not null").select(*keep, F.posexplode(players).alias("i", "player"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
    kind = F.coalesce(F.get("kinds", F.col("i")), F.try_element_at("kinds", F.lit(-1)), F.lit("unknown"))
    return out.withColumn("kind", kind).drop("i", "kinds")


def innings(rows: DataFrame) -> DataFrame:
    """Batting innings: match, innings, player, season, runs, balls, out; those out without facing a ball have 0 runs."""
    keys = ["match_id", "innings_number", "start_year", "scope"]
    faced = rows.groupBy(*keys, F.col("batter").alias("player")).agg(long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"), F.lit(0).alias("out"))
    gone = dismissals(rows, keys).groupBy(*keys, "player").agg(F.lit(0).cast("bigint").alias("runs"), F.lit(0).cast("bigint").alias("balls"), F.max((~F.col("kind").isin(*CENSORED_KINDS)).cast("int")).alias("out"))
    return faced.unionByName(gone).groupBy(*keys, "player").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.max("out").alias("out"))


def batting(spark: SparkSession, base: str) -> DataFrame:
    rows = scoped(spark, base)
    legal = F.col("legal_delivery")
    stats = rows.groupBy("scope", F.col("batter").alias("player"), "start_year").agg(
        long(F.col("batter_runs")).alias("runs"), long(legal).alias("balls"), long(F.col("is_dot")).alias("dots"), long(F.col("is_four")).alias("fours"), long(F.col("is_six")).alias("sixes"),
        long(legal * (F.col("batter_runs") == 1).cast("int")).alias("ones"), long(legal * (F.col("batter_runs") == 2).cast("int")).alias("twos"),
    )
    outs = innings(rows).groupBy("scope", "player", "start_year").agg(F.sum("out").alias("dismissals"))
    j = stats.join(outs, ["scope", "player", "start_year"], "left").withColumn("dismissals", F.coalesce("dismissals", F.lit(0)))
    b, f, s = F.col("balls"), F.col("fours"), F.col("sixes")
    return j.select(
        "scope", "player", "start_year", "runs", "balls", "dots", "fours", "sixes", "dismissals", F.round(safe_div(F.col("runs"), F.col("dismissals"), None), 4).alias("average"),
        pct(F.col("runs"), b).alias("strike_rate"), pct(F.col("dots"), b).alias("dot_pct"), pct(f + s, b).alias("boundary_pct"),
        F.round(safe_div(4 * f + 6 * s, F.col("runs")), 4).alias("boundary_dependency"), F.round(safe_div(F.col("ones") + F.col("twos"), b - f - s), 4).alias("rotation"),
    )


def acceleration(spark: SparkSession, base: str) -> DataFrame:
    rows = scoped(spark, base).groupBy("scope", F.col("batter").alias("player"), "start_year").pivot("phase", ["Powerplay", "Middle", "Death"])
    p = rows.agg(F.sum("batter_runs").alias("r"), F.sum("legal_delivery").alias("b"))
    rate = lambda x: 100 * safe_div(F.col(f"{x}_r"), F.col(f"{x}_b"), None)
    return p.select("scope", "player", "start_year", F.round(rate("Powerplay"), 4).alias("powerplay_sr"), F.round(rate("Middle"), 4).alias("middle_sr"), F.round(rate("Death"), 4).alias("death_sr"), F.round(rate("Death") - rate("Powerplay"), 4).alias("acceleration"))


def bowling(spark: SparkSession, base: str) -> DataFrame:
    g = scoped(spark, base).groupBy("scope", F.col("bowler").alias("player"), "start_year").agg(
        long(F.col("bowler_ball")).alias("balls"), long(F.col("conceded")).alias("runs"), long(F.col("is_credited")).alias("wickets"), long(F.col("is_dot")).alias("dots"), long(F.col("is_four") + F.col("is_six")).alias("boundaries"),
    )
    b, w = F.col("balls"), F.col("wickets")
    return g.select(
        "scope", "player", "start_year", "balls", "runs", "wickets", F.round(b / 6, 4).alias("overs"), F.round(6 * safe_div(F.col("runs"), b), 4).alias("economy"), F.round(safe_div(b, w, None), 4).alias("strike_rate"),
        pct(w, b).alias("wicket_rate"), pct(F.col("dots"), b).alias("dot_pct"), pct(F.col("boundaries"), b).alias("boundary_pct"),
    )


def spells(spark: SparkSession, base: str, max_gap: int = 2) -> DataFrame:
    """Bowling spells: successive overs of a bowler in an innings, at most ``max_gap`` over numbers apart."""
    keys = ["scope", "match_id", "innings_number", "bowler", "start_year"]
    overs = scoped(spark, base).groupBy(*keys, "over_number").agg(long(F.col("conceded")).alias("runs"), long(F.col("bowler_ball")).alias("balls"), long(F.col("is_credited")).alias("wickets"))
    order = Window.partitionBy(*keys).orderBy("over_number")
    # The running sum reads the flag, so the flag is a column of its own first.
    flagged = overs.withColumn("fresh", (F.coalesce(F.col("over_number") - F.lag("over_number").over(order), F.lit(max_gap + 1)) > max_gap).cast("int"))
    named = flagged.withColumn("spell", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return named.groupBy(*keys, "spell").agg(F.count("*").alias("overs"), F.sum("runs").alias("runs"), F.sum("balls").alias("balls"), F.sum("wickets").alias("wickets"))


def spell_variance(spark: SparkSession, base: str) -> DataFrame:
    s = spells(spark, base).where("balls > 0").withColumn("economy", 6 * F.col("runs") / F.col("balls"))
    variance = F.when(F.count("*") > 1, F.var_pop("economy")).otherwise(0.0)
    return s.groupBy("scope", F.col("bowler").alias("player"), "start_year").agg(F.count("*").alias("n_spells"), F.round(variance, 6).alias("spell_variance"))


def bowler_distribution(spark: SparkSession, base: str, min_spells: int = 3) -> DataFrame:
    s = spells(spark, base).where("scope = 'all' and balls > 0").withColumn("economy", 6 * F.col("runs") / F.col("balls"))
    q = F.percentile("economy", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = s.groupBy(F.col("bowler").alias("player")).agg(F.count("*").alias("n_spells"), q.alias("q"), F.avg((F.col("wickets") >= 2).cast("int")).alias("two"), F.sum("runs").alias("r"), F.sum("balls").alias("b"), F.max("start_year").alias("last_active"))
    return g.where(F.col("n_spells") >= min_spells).select("player", "n_spells", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], F.round("two", 4).alias("two_wicket_rate"), F.round(6 * F.col("r") / F.col("b"), 4).alias("economy"), "last_active", (F.col("last_active") >= 2025).alias("recently_active"))


def phases(spark: SparkSession, base: str) -> DataFrame:
    rows = scoped(spark, base)
    keys = ["scope", "player", "start_year", "phase"]
    bat = rows.withColumn("player", F.col("batter")).groupBy(*keys).agg(long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls_faced"))
    bowl = rows.withColumn("player", F.col("bowler")).groupBy(*keys).agg(long(F.col("conceded")).alias("conceded"), long(F.col("bowler_ball")).alias("balls_bowled"), long(F.col("is_credited")).alias("wickets"))
    j = bat.join(bowl, keys, "full").na.fill(0, ["runs", "balls_faced", "conceded", "balls_bowled", "wickets"])
    return j.select(*keys, "runs", "balls_faced", "conceded", "balls_bowled", "wickets", F.round(100 * safe_div(F.col("runs"), F.col("balls_faced"), None), 4).alias("strike_rate"), F.round(6 * safe_div(F.col("conceded"), F.col("balls_bowled"), None), 4).alias("economy"))


def badge(qualified: Column, failure: Column, impact: Column) -> Column:
    """Elite, High Floor, Boom-or-Bust or Moderate, in this order; Unqualified without enough innings."""
    return (
        F.when(~qualified, "Unqualified").when((failure <= 0.35) & (impact >= 0.20), "Elite").when(failure <= 0.40, "High Floor")
        .when((failure > 0.40) & (impact >= 0.20), "Boom-or-Bust").otherwise("Moderate")
    )


def consistency(spark: SparkSession, base: str, min_innings: int = 3) -> DataFrame:
    """Per player and season over matches batted or bowled in: score percentiles, failures, high impact and badge."""
    rows = scoped(spark, base)
    keys = ["scope", "player", "start_year"]
    bat = rows.withColumn("player", F.col("batter")).groupBy(*keys, "match_id").agg(long(F.col("batter_runs")).alias("runs"))
    bowl = rows.withColumn("player", F.col("bowler")).groupBy(*keys, "match_id").agg(long(F.col("is_credited")).alias("wickets"))
    perf = bat.join(bowl, [*keys, "match_id"], "full")
    n, m = F.count("runs"), F.count("*")
    q = F.percentile("runs", F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    failure, impact = safe_div(F.count_if(F.col("runs") < 10), n), safe_div(F.count_if((F.coalesce("runs", F.lit(0)) > 45) | (F.coalesce("wickets", F.lit(0)) >= 3)), m)
    g = perf.groupBy(*keys).agg(n.alias("innings_batted"), m.alias("matches_played"), q.alias("q"), failure.alias("failure"), impact.alias("impact"))
    return g.select(*keys, "innings_batted", "matches_played", *[F.round(F.col("q")[i], 4).alias(p) for i, p in enumerate(("p10", "p25", "p50", "p75", "p90"))], F.round("failure", 4).alias("failure_rate"), F.round("impact", 4).alias("impact_rate"), badge(F.col("innings_batted") >= min_innings, F.col("failure"), F.col("impact")).alias("badge"))


def batter_distribution(spark: SparkSession, base: str, min_innings: int = 2) -> DataFrame:
    i = innings(scoped(spark, base).where("scope = 'all'"))
    n, mean = F.count("*"), F.avg("runs")
    q = F.percentile("runs", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]))
    skew = F.when(F.stddev_pop("runs") > 0, F.skewness("runs")).otherwise(0.0)
    g = i.groupBy("player").agg(n.alias("n_innings"), F.sum("runs").alias("runs"), F.sum("out").cast("bigint").alias("outs"), F.round(mean, 4).alias("mean_score"), q.alias("q"), F.round(F.when(n >= 3, skew), 5).alias("skewness"), F.count_if((F.col("runs") == 0) & (F.col("out") == 1)).alias("ducks"))
    return g.where(F.col("n_innings") >= min_innings).select("player", "n_innings", "runs", "outs", "mean_score", *[F.round(F.col("q")[k], 4).alias(p) for k, p in enumerate(("p10", "median_score", "p90"))], "skewness", "ducks")


def reach(spark: SparkSession, base: str, marks: tuple[int, ...] = (20, 30, 50)) -> DataFrame:
    """P(score >= t) three ways: of all innings, without those not out below t, and by the survival product.

    Not-out innings are censored: of the players still in at a score u, d_u of n_u are out there, and the chance to
    reach t is the product of 1 - d_u / n_u over u < t.
    """
    i = innings(scoped(spark, base).where("scope = 'all'"))
    at = i.groupBy("player", "runs").agg(F.sum("out").alias("d"), F.count("*").alias("c"))
    at = at.withColumn("n", F.sum("c").over(Window.partitionBy("player").orderBy(F.desc("runs")).rowsBetween(Window.unboundedPreceding, 0)))
    marked = at.withColumn("t", F.explode(F.array(*map(F.lit, marks))))
    reached = F.sum(F.when(F.col("runs") >= F.col("t"), F.col("c")).otherwise(0))
    out_below = F.sum(F.when(F.col("runs") < F.col("t"), F.col("d")).otherwise(0))
    factor = F.when((F.col("runs") < F.col("t")) & (F.col("d") > 0), 1 - F.col("d") / F.col("n"))
    g = marked.groupBy("player", F.col("t").alias("mark")).agg(F.sum("c").alias("n_innings"), F.round(reached / F.sum("c"), 6).alias("naive"), F.round(safe_div(reached, reached + out_below, None), 6).alias("complete_case"), F.round(F.coalesce(F.product(factor), F.lit(1.0)), 6).alias("survival"))
    return g


def conversion(spark: SparkSession, base: str, start: int = 10, end: int = 20) -> DataFrame:
    """Of the innings that reached ``start``, the share that reached ``end``, without those not out between."""
    i = innings(scoped(spark, base).where("scope = 'all'")).where(F.col("runs") >= start)
    made, out = F.count_if(F.col("runs") >= end), F.count_if((F.col("runs") < end) & (F.col("out") == 1))
    return i.groupBy("player").agg(F.count("*").alias("n_started"), F.round(safe_div(made, made + out, None), 6).alias("conversion"))


def leaderboards(spark: SparkSession, base: str, top: int = 10, min_balls: int = 12) -> DataFrame:
    """The best batters of each phase and measure, in a career and a recent window (ties by name)."""
    rows = population(fact(spark, base)).withColumn("window", F.explode(F.when(F.col("start_year") >= 2024, F.array(F.lit("career"), F.lit("recent"))).otherwise(F.array(F.lit("career")))))
    g = rows.groupBy("window", "phase", F.col("batter").alias("player")).agg(long(F.col("legal_delivery")).alias("balls"), long(F.col("batter_runs")).alias("r"), long(F.col("is_dot")).alias("d"), long(F.col("is_four") + F.col("is_six")).alias("x")).where(F.col("balls") >= min_balls)
    m = g.select("window", "phase", "player", "balls", pct(F.col("r"), F.col("balls")).alias("strike_rate"), pct(F.col("x"), F.col("balls")).alias("boundary_pct"), (100 - pct(F.col("d"), F.col("balls"))).alias("scoring_pct"))
    long_form = m.unpivot(["window", "phase", "player", "balls"], ["strike_rate", "boundary_pct", "scoring_pct"], "measure", "value")
    rank = F.row_number().over(Window.partitionBy("window", "phase", "measure").orderBy(F.desc("value"), F.desc("balls"), "player"))
    return long_form.withColumn("place", rank).where(F.col("place") <= top).withColumn("value", F.round("value", 4))


def venue_conditional(spark: SparkSession, base: str, min_balls: int = 10) -> DataFrame:
    rows = population(fact(spark, base), gender=None)
    g = rows.where("venue is not null").groupBy("venue", F.col("batter").alias("player")).agg(long(F.col("legal_delivery")).alias("balls"), long(F.col("batter_runs")).alias("runs"))
    return g.where(F.col("balls") >= min_balls).withColumn("strike_rate", pct(F.col("runs"), F.col("balls")))


def batting_store(spark: SparkSession, base: str) -> DataFrame:
    """Career batting by phase over all rows of the fact; a divisor of 0 counts as 1, rates are rounded half to even."""
    g = fact(spark, base).groupBy(F.col("batter").alias("player"), "phase").agg(
        long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"), long(F.col("is_four")).alias("fours"), long(F.col("is_six")).alias("sixes"), long(F.col("is_dot")).alias("dots"),
    )
    share = lambda c: F.bround(100 * c / F.when(F.col("balls") == 0, 1).otherwise(F.col("balls")), 2)
    return g.withColumns({"strike_rate": share(F.col("runs")), "boundary_pct": share(F.col("fours") + F.col("sixes")), "dot_pct": share(F.col("dots"))})


def bowling_store(spark: SparkSession, base: str) -> DataFrame:
    """Career bowling by phase: all runs (byes too), every wicket, economy, and balls a wicket (NULL without one)."""
    g = fact(spark, base).groupBy(F.col("bowler").alias("player"), "phase").agg(long(F.col("total_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"), long(F.col("is_wicket")).alias("wickets"))
    b = F.col("balls")
    return g.withColumns({
        "economy": F.bround(6 * F.col("runs") / F.when(b == 0, 1).otherwise(b), 2), "strike_rate": F.bround(safe_div(b, F.col("wickets"), None), 2),
    })


def bowler_seasons(spark: SparkSession, base: str, min_overs: float = 2.0) -> DataFrame:
    """Seasons of bowlers with enough overs in the all-league scope: wickets, economy, balls a wicket."""
    b = bowling(spark, base).where("scope = 'all'").where(F.col("overs") >= min_overs)
    return b.select("player", "start_year", "overs", "runs", "wickets", "economy", "strike_rate")


def player_matches(spark: SparkSession, base: str) -> DataFrame:
    """What a player did in a match: runs, balls and whether it batted, balls bowled, runs given and credited wickets."""
    rows = population(fact(spark, base))
    keys = ["match_id", "player", "start_year"]
    bat = rows.withColumn("player", F.col("batter")).groupBy(*keys).agg(long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls_faced"))
    bowl = rows.withColumn("player", F.col("bowler")).groupBy(*keys).agg(long(F.col("bowler_ball")).alias("balls_bowled"), long(F.col("conceded")).alias("conceded"), long(F.col("is_credited")).alias("wickets"))
    both = bat.withColumn("batted", F.lit(True)).join(bowl.withColumn("bowled", F.lit(True)), keys, "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return both.select(*keys, no("batted"), zero("runs"), zero("balls_faced"), no("bowled"), zero("balls_bowled"), zero("conceded"), zero("wickets"))


def venue_bowling(spark: SparkSession, base: str, min_balls: int = 10) -> DataFrame:
    """A bowler's economy at each ground, with enough balls there."""
    rows = population(fact(spark, base), gender=None).where("venue is not null")
    g = rows.groupBy("venue", F.col("bowler").alias("player")).agg(long(F.col("bowler_ball")).alias("balls"), long(F.col("conceded")).alias("conceded"))
    return g.where(F.col("balls") >= min_balls).withColumn("economy", F.round(6 * F.col("conceded") / F.col("balls"), 4))


def expensive_overs(spark: SparkSession, base: str, runs: int = 12) -> DataFrame:
    """Of each bowler's overs, the share that cost ``runs`` or more, and the share of dot balls."""
    rows = scoped(spark, base).where("scope = 'all'")
    overs = rows.groupBy(F.col("bowler").alias("player"), "match_id", "innings_number", "over_number").agg(long(F.col("conceded")).alias("r"), long(F.col("bowler_ball")).alias("b"), long(F.col("is_dot")).alias("d"))
    g = overs.groupBy("player").agg(F.count("*").alias("n_overs"), F.count_if(F.col("r") >= runs).alias("n_expensive"), F.sum("d").alias("d"), F.sum("b").alias("b"))
    return g.select("player", "n_overs", "n_expensive", F.round(F.col("n_expensive") / F.col("n_overs"), 4).alias("expensive_rate"), pct(F.col("d"), F.col("b")).alias("dot_pct"))


def sorted_seasons(spark: SparkSession, base: str) -> DataFrame:
    """Season rows of the main scope with their place in the order: runs descending, average descending with NULL last,
    name ascending. The order is a range sort of the whole; the place comes from the ranks, not from one task."""
    rows = batting(spark, base).where("scope = 'all'")
    key = F.concat_ws("|", F.lpad((F.lit(10**12) - F.col("runs")).cast("string"), 13, "0"), F.lpad(F.coalesce((F.lit(10**9) - F.round(F.col("average") * 10_000)).cast("bigint"), F.lit(10**12)).cast("string"), 13, "0"), F.col("player"), F.col("start_year").cast("string"))
    placed = dense_ranks(rows.withColumn("_key", key), "_key", "place").drop("_key")
    return placed.select("place", "player", "start_year", "runs", "average").orderBy("place")


def ordered_leagues(spark: SparkSession, base: str) -> DataFrame:
    """Leagues by run rate, highest first (ties by name): a report of few rows, sorted for people."""
    rows = population(fact(spark, base), gender=None).groupBy("competition").agg(long(F.col("total_runs")).alias("r"), long(F.col("legal_delivery")).alias("b"))
    rated = rows.select("competition", F.round(6 * safe_div(F.col("r"), F.col("b")), 4).alias("run_rate"))
    return rated.orderBy(F.desc_nulls_last("run_rate"), F.asc_nulls_last("competition"))


def close_percentiles(spark: SparkSession, base: str, tolerance: float = 1e-9) -> DataFrame:
    """Whether the median of scores equals the 50th percentile within a tolerance, by player (it must everywhere)."""
    i = innings(scoped(spark, base).where("scope = 'all'"))
    g = i.groupBy("player").agg(F.median("runs").alias("a"), F.percentile("runs", F.lit(0.5)).alias("b"), F.avg("runs").alias("m"))
    return g.select("player", (F.abs(F.col("a") - F.col("b")) < tolerance).alias("is_equal"), F.round(F.greatest(F.lit(0.0), F.least(F.col("m") / 50, F.lit(1.0))), 6).alias("clipped_mean"))


QUERIES = {
    "f03_batting_store": batting_store, "f04_bowling_store": bowling_store, "f13_bowler_seasons": bowler_seasons, "f15_player_matches": player_matches, "f26_venue_bowling": venue_bowling,
    "f12_expensive_overs": expensive_overs, "k01_sorted": sorted_seasons, "k04_leagues": ordered_leagues, "n07_tolerance": close_percentiles,
    "f05_innings": lambda s, b: innings(scoped(s, b)), "f06_season_batting": batting, "f08_acceleration": acceleration, "f10_season_bowling": bowling, "w03_spells": spells, "f11_spell_variance": spell_variance,
    "f12_bowler_distribution": bowler_distribution, "f14_phases": phases, "f16_consistency": consistency, "f17_batter_distribution": batter_distribution, "m01_reach": reach, "m03_conversion": conversion,
    "k03_leaderboards": leaderboards, "f26_venue_conditional": venue_conditional,
}

INNINGS_SQL = """
ev as (select *, list_filter(list_transform(string_split(dismissal_player_out, '|'), lambda x: trim(x)), lambda x: x <> '') ps,
        list_filter(list_transform(string_split(dismissal_type, '|'), lambda x: lower(trim(x))), lambda x: x <> '') ks from scoped where dismissal_player_out is not null),
ex as (select match_id, innings_number, start_year, scope, unnest(ps) player, generate_subscripts(ps, 1) i, ks from ev),
gone as (select match_id, innings_number, start_year, scope, player, max((coalesce(ks[i], ks[-1], 'unknown') not in ('retired hurt', 'retired not out'))::int) out from ex group by all),
faced as (select match_id, innings_number, start_year, scope, batter player, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls from scoped group by all),
inn as (select match_id, innings_number, start_year, scope, player, coalesce(f.runs, 0) runs, coalesce(f.balls, 0) balls, coalesce(g.out, 0) out
        from faced f full join gone g using (match_id, innings_number, start_year, scope, player))
"""
SPELLS_SQL = """
ov as (select scope, match_id, innings_number, bowler, start_year, over_number, sum(conceded)::bigint runs, sum(bowler_ball)::bigint balls, sum(is_credited)::bigint wickets from scoped group by all),
fl as (select *, (coalesce(over_number - lag(over_number) over w, 3) > 2)::int fresh from ov window w as (partition by scope, match_id, innings_number, bowler, start_year order by over_number)),
nm as (select *, sum(fresh) over (partition by scope, match_id, innings_number, bowler, start_year order by over_number rows unbounded preceding)::bigint spell from fl),
sp as (select scope, match_id, innings_number, bowler, start_year, spell, count(*) overs, sum(runs)::bigint runs, sum(balls)::bigint balls, sum(wickets)::bigint wickets from nm group by all)
"""

SQL = {
    "f05_innings": sql(f", {INNINGS_SQL} select * from inn"),
    "f06_season_batting": sql(f""", {INNINGS_SQL}, st as (select scope, batter player, start_year, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls, sum(is_dot)::bigint dots, sum(is_four)::bigint fours,
        sum(is_six)::bigint sixes, sum(legal_delivery * (batter_runs = 1)::int)::bigint ones, sum(legal_delivery * (batter_runs = 2)::int)::bigint twos from scoped group by all),
        o as (select scope, player, start_year, sum(out)::bigint dismissals from inn group by all)
        select scope, player, start_year, runs, balls, dots, fours, sixes, coalesce(dismissals, 0)::bigint dismissals, round(runs / nullif(dismissals, 0), 4) average,
        case when balls > 0 then round(100 * (runs / balls), 4) else 0 end strike_rate, case when balls > 0 then round(100 * (dots / balls), 4) else 0 end dot_pct,
        case when balls > 0 then round(100 * ((fours + sixes) / balls), 4) else 0 end boundary_pct, case when runs > 0 then round((4 * fours + 6 * sixes) / runs, 4) else 0 end boundary_dependency,
        case when balls - fours - sixes > 0 then round((ones + twos) / (balls - fours - sixes), 4) else 0 end rotation from st left join o using (scope, player, start_year)"""),
    "f08_acceleration": sql(""", p as (select scope, batter player, start_year, 100 * (sum(batter_runs) filter (phase = 'Powerplay') / nullif(sum(legal_delivery) filter (phase = 'Powerplay'), 0)) a,
        100 * (sum(batter_runs) filter (phase = 'Middle') / nullif(sum(legal_delivery) filter (phase = 'Middle'), 0)) b, 100 * (sum(batter_runs) filter (phase = 'Death') / nullif(sum(legal_delivery) filter (phase = 'Death'), 0)) c
        from scoped group by all) select scope, player, start_year, round(a, 4) powerplay_sr, round(b, 4) middle_sr, round(c, 4) death_sr, round(c - a, 4) acceleration from p"""),
    "f10_season_bowling": sql(""", g as (select scope, bowler player, start_year, sum(bowler_ball)::bigint balls, sum(conceded)::bigint runs, sum(is_credited)::bigint wickets, sum(is_dot)::bigint dots, sum(is_four + is_six)::bigint x
        from scoped group by all) select scope, player, start_year, balls, runs, wickets, round(balls / 6, 4) overs, case when balls > 0 then round(6 * (runs / balls), 4) else 0 end economy, round(balls / nullif(wickets, 0), 4) strike_rate,
        case when balls > 0 then round(100 * (wickets / balls), 4) else 0 end wicket_rate, case when balls > 0 then round(100 * (dots / balls), 4) else 0 end dot_pct, case when balls > 0 then round(100 * (x / balls), 4) else 0 end boundary_pct from g"""),
    "w03_spells": sql(f", {SPELLS_SQL} select * from sp"),
    "f11_spell_variance": sql(f", {SPELLS_SQL} select scope, bowler player, start_year, count(*) n_spells, round(case when count(*) > 1 then var_pop(6 * runs / balls) else 0 end, 6) spell_variance from sp where balls > 0 group by all"),
    "f12_bowler_distribution": sql(f""", {SPELLS_SQL} select bowler player, count(*) n_spells, round(quantile_cont(6 * runs / balls, 0.1), 4) p10, round(quantile_cont(6 * runs / balls, 0.5), 4) p50, round(quantile_cont(6 * runs / balls, 0.9), 4) p90,
        round(avg((wickets >= 2)::int), 4) two_wicket_rate, round(6 * sum(runs) / sum(balls), 4) economy, max(start_year) last_active, max(start_year) >= 2025 recently_active from sp where scope = 'all' and balls > 0 group by 1 having count(*) >= 3"""),
    "f14_phases": sql(""", a as (select scope, batter player, start_year, phase, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls_faced from scoped group by all),
        b as (select scope, bowler player, start_year, phase, sum(conceded)::bigint conceded, sum(bowler_ball)::bigint balls_bowled, sum(is_credited)::bigint wickets from scoped group by all),
        j as (select scope, player, start_year, phase, coalesce(runs, 0) runs, coalesce(balls_faced, 0) balls_faced, coalesce(conceded, 0) conceded, coalesce(balls_bowled, 0) balls_bowled, coalesce(wickets, 0) wickets
        from a full join b using (scope, player, start_year, phase)) select *, round(100 * (runs / nullif(balls_faced, 0)), 4) strike_rate, round(6 * (conceded / nullif(balls_bowled, 0)), 4) economy from j"""),
    "f16_consistency": sql(""", a as (select scope, batter player, start_year, match_id, sum(batter_runs)::bigint runs from scoped group by all), b as (select scope, bowler player, start_year, match_id, sum(is_credited)::bigint wickets from scoped group by all),
        p as (select * from a full join b using (scope, player, start_year, match_id)),
        g as (select scope, player, start_year, count(runs) innings_batted, count(*) matches_played, round(quantile_cont(runs, 0.1), 4) p10, round(quantile_cont(runs, 0.25), 4) p25, round(quantile_cont(runs, 0.5), 4) p50,
        round(quantile_cont(runs, 0.75), 4) p75, round(quantile_cont(runs, 0.9), 4) p90, case when count(runs) > 0 then count(*) filter (runs < 10) / count(runs) else 0 end f, count(*) filter (coalesce(runs, 0) > 45 or coalesce(wickets, 0) >= 3) / count(*) i from p group by all)
        select scope, player, start_year, innings_batted, matches_played, p10, p25, p50, p75, p90, round(f, 4) failure_rate, round(i, 4) impact_rate, case when innings_batted < 3 then 'Unqualified' when f <= 0.35 and i >= 0.20 then 'Elite' when f <= 0.40 then 'High Floor'
        when i >= 0.20 then 'Boom-or-Bust' else 'Moderate' end badge from g"""),
    "f17_batter_distribution": sql(f""", {INNINGS_SQL}, mo as (select player, avg(runs) mu, stddev_pop(runs) sd from inn where scope = 'all' group by 1)
        select player, count(*) n_innings, sum(runs)::bigint runs, sum(out)::bigint outs, round(avg(runs), 4) mean_score, round(quantile_cont(runs, 0.1), 4) p10, round(quantile_cont(runs, 0.5), 4) median_score, round(quantile_cont(runs, 0.9), 4) p90,
        round(case when count(*) < 3 then null when max(sd) > 0 then avg(power((runs - mu) / nullif(sd, 0), 3)) else 0 end, 5) skewness, count(*) filter (runs = 0 and out = 1) ducks from inn join mo using (player) where scope = 'all' group by 1 having count(*) >= 2"""),
    "m01_reach": sql(f""", {INNINGS_SQL}, at0 as (select player, runs, sum(out) d, count(*) c from inn where scope = 'all' group by 1, 2), at1 as (select *, sum(c) over (partition by player order by runs desc rows unbounded preceding) n from at0),
        mk as (select *, unnest([20, 30, 50]) mark from at1)
        select player, mark, sum(c)::bigint n_innings, round(sum(case when runs >= mark then c else 0 end) / sum(c), 6) naive, round(sum(case when runs >= mark then c else 0 end) / nullif(sum(case when runs >= mark then c else d end), 0), 6) complete_case,
        round(coalesce(product(1 - d / n) filter (runs < mark and d > 0), 1), 6) survival from mk group by 1, 2"""),
    "m03_conversion": sql(f""", {INNINGS_SQL} select player, count(*) n_started, round(count(*) filter (runs >= 20) / nullif(count(*) filter (runs >= 20 or out = 1), 0), 6) conversion from inn where scope = 'all' and runs >= 10 group by 1"""),
    "k03_leaderboards": sql(""", w as (select *, unnest(case when start_year >= 2024 then ['career', 'recent'] else ['career'] end) as "window" from pop),
        g as (select "window", phase, batter player, sum(legal_delivery)::bigint balls, sum(batter_runs) r, sum(is_dot) d, sum(is_four + is_six) x from w group by all having sum(legal_delivery) >= 12),
        l as (select "window", phase, player, balls, 'strike_rate' measure, round(100 * (r / balls), 4) v from g union all select "window", phase, player, balls, 'boundary_pct', round(100 * (x / balls), 4) from g
        union all select "window", phase, player, balls, 'scoring_pct', 100 - round(100 * (d / balls), 4) from g),
        k as (select *, row_number() over (partition by "window", phase, measure order by v desc, balls desc, player)::int place from l) select "window", phase, player, balls, measure, round(v, 4) as value, place from k where place <= 10"""),
    "f26_venue_conditional": sql("""select venue, batter player, sum(legal_delivery)::bigint balls, sum(batter_runs)::bigint runs, round(100 * (sum(batter_runs) / sum(legal_delivery)), 4) strike_rate from fact
        where start_year between 2018 and 2026 and not coalesce(is_super_over, false) and venue is not null group by 1, 2 having sum(legal_delivery) >= 10"""),
}
POP_ALL = "start_year between 2018 and 2026 and not coalesce(is_super_over, false)"
SQL |= {
    "f03_batting_store": sql("""select batter player, phase, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls, sum(is_four)::bigint fours, sum(is_six)::bigint sixes, sum(is_dot)::bigint dots,
        round_even(100 * sum(batter_runs) / greatest(sum(legal_delivery), 1), 2) strike_rate, round_even(100 * sum(is_four + is_six) / greatest(sum(legal_delivery), 1), 2) boundary_pct,
        round_even(100 * sum(is_dot) / greatest(sum(legal_delivery), 1), 2) dot_pct from fact group by all"""),
    "f04_bowling_store": sql("""select bowler player, phase, sum(total_runs)::bigint runs, sum(legal_delivery)::bigint balls, sum(is_wicket)::bigint wickets, round_even(6 * sum(total_runs) / greatest(sum(legal_delivery), 1), 2) economy,
        round_even(sum(legal_delivery) / nullif(sum(is_wicket), 0), 2) strike_rate from fact group by all"""),
    "f13_bowler_seasons": f"select player, start_year, overs, runs, wickets, economy, strike_rate from ({SQL['f10_season_bowling']}) where scope = 'all' and overs >= 2",
    "f15_player_matches": sql(""", a as (select match_id, batter player, start_year, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls_faced from pop group by all),
        b as (select match_id, bowler player, start_year, sum(bowler_ball)::bigint balls_bowled, sum(conceded)::bigint conceded, sum(is_credited)::bigint wickets from pop group by all)
        select match_id, player, start_year, runs is not null batted, coalesce(runs, 0) runs, coalesce(balls_faced, 0) balls_faced, conceded is not null bowled, coalesce(balls_bowled, 0) balls_bowled, coalesce(conceded, 0) conceded,
        coalesce(wickets, 0) wickets from a full join b using (match_id, player, start_year)"""),
    "f26_venue_bowling": sql(f"select venue, bowler player, sum(bowler_ball)::bigint balls, sum(conceded)::bigint conceded, round(6 * sum(conceded) / sum(bowler_ball), 4) economy from fact where {POP_ALL} and venue is not null group by all having sum(bowler_ball) >= 10"),
    "f12_expensive_overs": sql(""", o as (select bowler player, sum(conceded) r, sum(bowler_ball) b, sum(is_dot) d from scoped where scope = 'all' group by bowler, match_id, innings_number, over_number)
        select player, count(*) n_overs, count(*) filter (r >= 12) n_expensive, round(count(*) filter (r >= 12) / count(*), 4) expensive_rate, case when sum(b) > 0 then round(100 * (sum(d) / sum(b)), 4) else 0 end dot_pct from o group by 1"""),
    "k01_sorted": f"select row_number() over (order by runs desc, average desc nulls last, player, start_year) place, player, start_year, runs, average from ({SQL['f06_season_batting']}) where scope = 'all'",
    "k04_leagues": sql(f"select competition, round(6 * (sum(total_runs) / sum(legal_delivery)), 4) run_rate from fact where {POP_ALL} group by 1"),
    "n07_tolerance": sql(f", {INNINGS_SQL} select player, abs(median(runs) - quantile_cont(runs, 0.5)) < 1e-9 is_equal, round(greatest(0, least(avg(runs) / 50, 1)), 6) clipped_mean from inn where scope = 'all' group by 1"),
}
