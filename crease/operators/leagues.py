"""Strength of leagues, translation between levels of play, rank statistics and joins over seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.prefix import medians, rank_percentiles
from crease.functions.scalars import safe_div
from crease.operators.facts import fact, long, population, sql, with_scopes
from crease.operators.features import dismissals
from crease.sources.tables import durable

BASELINE = "ipl"
#: Qualification of crossover players: own dismissals, balls bowled (5 and 60 suit tables of a million rows and more).
MIN_OUTS, MIN_BOWLED = 1, 12


def league_batting(spark: SparkSession, base: str) -> DataFrame:
    rows = population(fact(spark, base))
    keys = ["competition", "start_year"]
    runs = rows.groupBy(*keys, F.col("batter").alias("player")).agg(long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"))
    outs = dismissals(rows, keys).where(~F.col("kind").isin("retired hurt", "retired not out")).groupBy(*keys, "player").agg(F.count("*").alias("outs"))
    return runs.join(outs, [*keys, "player"], "left").withColumn("outs", F.coalesce("outs", F.lit(0)))


def own_rates(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(batting, bowling) of each player and league over all seasons: the average by the batter's own dismissals (the
    player out is the batter on strike), the economy by legal balls; NULL without dismissals or balls."""
    rows = population(fact(spark, base))
    own = F.count_if((F.col("is_wicket") == 1) & (F.col("dismissal_player_out") == F.col("batter")))
    bat = rows.groupBy("competition", F.col("batter").alias("player")).agg(long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"), own.alias("outs"))
    bowl = rows.groupBy("competition", F.col("bowler").alias("player")).agg(long(F.col("conceded")).alias("runs"), long(F.col("bowler_ball")).alias("balls"))
    bat = bat.withColumn("rate", safe_div(F.col("runs"), F.col("outs"), None))
    return bat, bowl.withColumn("rate", 6 * safe_div(F.col("runs"), F.col("balls"), None))


def crossover_ratio(rates: DataFrame, enough: Column, name: str) -> DataFrame:
    """For each other league the mean of its players' rate over their own rate in the main league, and how many they are."""
    good = rates.where(enough & (F.col("rate") > 0)).select("competition", "player", "rate")
    home = good.where(F.col("competition") == BASELINE).select("player", F.col("rate").alias("home"))
    away = good.where(F.col("competition") != BASELINE).join(home, "player")
    return away.groupBy("competition").agg(F.avg(F.col("rate") / F.col("home")).alias(f"{name}_ratio"), F.count("*").alias(f"n_{name}"))


def league_factors(spark: SparkSession, base: str, min_outs: int = MIN_OUTS, min_balls: int = MIN_BOWLED) -> DataFrame:
    """Strength of each league: mean ratio of crossover players' averages (economies) to the main league's, and its inverse.

    A league without a crossover player has NULL, never 1; the main league has 1. Players count with at least
    ``min_outs`` dismissals or ``min_balls`` balls bowled in both leagues.
    """
    bat, bowl = own_rates(spark, base)
    leagues = population(fact(spark, base)).select("competition").distinct()
    j = leagues.join(crossover_ratio(bat, F.col("outs") >= min_outs, "batting"), "competition", "left")
    j = j.join(crossover_ratio(bowl, F.col("balls") >= min_balls, "bowling"), "competition", "left")
    at_home = lambda c: F.when(F.col("competition") == BASELINE, 1.0).otherwise(c)
    columns = ["competition"]
    for x in ("batting", "bowling"):
        ratio = F.col(f"{x}_ratio")
        columns += [F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}"), F.round(at_home(ratio), 5).alias(f"{x}_ratio"), F.round(at_home(safe_div(F.lit(1.0), ratio, None)), 5).alias(f"{x}_factor")]
    return j.select(*columns)


def factors_applied(spark: SparkSession, base: str) -> DataFrame:
    """The factor that applies to each season row of players: 1 in the main league's scope, NULL in the pooled scope, which
    no single league's factor fits."""
    rows = with_scopes(population(fact(spark, base)))
    of = lambda c, name: rows.select("scope", F.col(c).alias("player"), "start_year").distinct().withColumn(name, F.when(F.col("scope") == BASELINE, 1.0))
    return of("batter", "batting_factor").join(of("bowler", "bowling_factor"), ["scope", "player", "start_year"], "full")


def adjusted(spark: SparkSession, base: str) -> DataFrame:
    """Each player's average and economy over all leagues, runs weighted by the league's factor (an unknown factor adds 0
    runs). A ratio of sums; NULL without dismissals or balls."""
    factors = league_factors(spark, base)
    bat, bowl = own_rates(spark, base)
    weighted = lambda rows, f: rows.join(factors.select("competition", F.col(f).alias("factor")), "competition", "left").withColumn("w", F.col("runs") * F.col("factor"))
    a = weighted(bat, "batting_factor").groupBy("player").agg(F.sum("runs").alias("runs"), F.sum("outs").alias("outs"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("wa"))
    b = weighted(bowl, "bowling_factor").groupBy("player").agg(F.sum("runs").alias("conceded"), F.sum("balls").alias("balls"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("wb"))
    return a.join(b, "player", "full").select(
        "player", "runs", "outs", F.round(safe_div(F.col("wa"), F.col("outs"), None), 3).alias("adjusted_average"), "conceded", "balls",
        F.round(6 * safe_div(F.col("wb"), F.col("balls"), None), 3).alias("adjusted_economy"),
    )


def average_rank_pct(value: Column, part: list) -> Column:
    """Average-rank percentile of non-NULL values within small groups ``part``; highest is (n - ties/2 + 1/2) / n.

    For groups of any size see ``rank_percentiles``.
    """
    order = Window.partitionBy(*part).orderBy(value)
    ties = F.count(value).over(Window.partitionBy(*part, value))
    # NULL sorts first, so their number is taken off the rank.
    nulls = F.count_if(value.isNull()).over(Window.partitionBy(*part))
    return F.when(value.isNotNull(), (F.rank().over(order) - nulls + (ties - 1) / 2) / F.count(value).over(Window.partitionBy(*part)))


def translated(g: DataFrame, metrics: dict[str, bool]) -> DataFrame:
    """g (player, start_year, metrics; NULL where not qualified) + for each metric its percentile in the season, its
    dominance (value to the season's mean) and whether the player's variance over seasons is above the median of all.

    metrics: name -> whether the highest value is best. A player with one qualified season has no flag.
    """
    out = durable(g)
    for m, highest in metrics.items():
        rows = rank_percentiles(out, ["start_year"], m, f"{m}_percentile", highest_first=not highest)
        mean = out.groupBy("start_year").agg(F.avg(m).alias("_mean"))
        rows = rows.join(mean, "start_year", "left").withColumn(f"{m}_dominance", safe_div(F.col(m), F.col("_mean"), None)).drop("_mean")
        spread = out.where(F.col(m).isNotNull()).groupBy("player").agg(F.var_pop(m).alias("_v"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
        spread = durable(spread.withColumn("_v", F.round("_v", 12)))
        flags = spread.crossJoin(F.broadcast(medians(spread, [], "_v", "_m"))).select("player", (F.col("_v") > F.col("_m")).alias(f"{m}_variance_flag"))
        out = durable(rows.join(flags, "player", "left"))
    return out


def translation(spark: SparkSession, base: str, level: str = "sma", min_balls: int = 12) -> DataFrame:
    """Percentile, dominance and variance flag of the strike rate of domestic batting, per season."""
    g = league_batting(spark, base).where(F.col("competition") == level)
    g = g.withColumn("sr", F.when(F.col("balls") >= min_balls, 100 * F.col("runs") / F.col("balls")))
    j = translated(g.select("player", "start_year", "balls", "sr"), {"sr": True})
    return j.select(
        "player", "start_year", "balls", F.round("sr", 4).alias("strike_rate"), F.round("sr_percentile", 6).alias("percentile"), F.round("sr_dominance", 6).alias("dominance"),
        F.col("sr_variance_flag").alias("variance_flag"),
    )


def translation_features(spark: SparkSession, base: str, level: str = "sma", min_balls: int = 12) -> DataFrame:
    """Domestic batting (strike rate, average) and bowling (economy, where low is best, and wickets an over) in one table,
    each with percentile, dominance and variance flag; the other side's columns are NULL."""
    bat = league_batting(spark, base).where(F.col("competition") == level)
    ok = F.col("balls") >= min_balls
    bat = bat.select("player", "start_year", "balls", F.when(ok, 100 * F.col("runs") / F.col("balls")).alias("strike_rate"), F.when(ok, safe_div(F.col("runs"), F.col("outs"), None)).alias("average"))
    rows = population(fact(spark, base)).where(F.col("competition") == level)
    bowl = rows.groupBy(F.col("bowler").alias("player"), "start_year").agg(long(F.col("bowler_ball")).alias("balls"), long(F.col("conceded")).alias("r"), long(F.col("is_credited")).alias("w"))
    bowl = bowl.select("player", "start_year", "balls", F.when(ok, 6 * F.col("r") / F.col("balls")).alias("economy"), F.when(ok, 6 * F.col("w") / F.col("balls")).alias("wicket_rate"))
    a = translated(bat, {"strike_rate": True, "average": True}).withColumn("player_type", F.lit("batting"))
    b = translated(bowl, {"economy": False, "wicket_rate": True}).withColumn("player_type", F.lit("bowling"))
    both = a.unionByName(b, allowMissingColumns=True)
    return both.select("player", "start_year", "player_type", "balls", *[F.round(c, 6).alias(c) if t == "double" else c for c, t in both.dtypes if c not in ("player", "start_year", "player_type", "balls")])


def uncapped(spark: SparkSession, base: str, level: str = "sma") -> DataFrame:
    rows = population(fact(spark, base))
    ids = lambda c: rows.where(F.col("competition") == c).select(F.explode(F.array("batter", "bowler")).alias("player")).distinct()
    return ids(level).join(ids(BASELINE), "player", "left_anti")


def crossover_cohort(spark: SparkSession, base: str, min_balls: int = 6) -> DataFrame:
    """Players with a season of the baseline league within a year of another league's, and their ratio of rates."""
    g = league_batting(spark, base).withColumn("tier", F.when(F.col("competition") == BASELINE, "main").otherwise("other"))
    g = g.groupBy("player", "start_year", "tier").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls"))
    main, other = g.where("tier = 'main'").alias("i"), g.where("tier = 'other'").alias("d")
    near = other.join(main, (F.col("i.player") == F.col("d.player")) & (F.abs(F.col("i.start_year") - F.col("d.start_year")) <= 1), "left_semi").select("player").distinct()
    p = g.join(near, "player", "left_semi").groupBy("player").pivot("tier", ["main", "other"]).agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls"))
    p = p.where((F.col("main_balls") >= min_balls) & (F.col("other_balls") >= min_balls) & (F.col("other_runs") > 0))
    return p.select("player", "main_balls", "other_balls", F.round((F.col("main_runs") / F.col("main_balls")) / (F.col("other_runs") / F.col("other_balls")), 5).alias("ratio"))


def cohort_summary(spark: SparkSession, base: str, least: int = 30) -> DataFrame:
    """The crossover cohort in one row: how many, mean and median ratio, and whether they are enough to tell."""
    rows = crossover_cohort(spark, base)
    middle = medians(rows, [], "ratio", "median_ratio")
    one = rows.agg(F.count("*").alias("n_players"), F.round(F.avg("ratio"), 5).alias("mean_ratio"))
    return one.join(middle).select("n_players", "mean_ratio", F.round("median_ratio", 5).alias("median_ratio"), (F.col("n_players") >= least).alias("is_enough"))


def identity_baseline(spark: SparkSession, base: str, lag: int = 1, min_balls: int = 4) -> DataFrame:
    """A season's percentile as the guess of the player's next one, against the constant 0.5, for each measure.

    Percentiles run from 0 to 1 (values given up to 100 are scaled down); where the measure turns round from season to
    season (a negative rank correlation) the guess is turned round too.
    """
    rows = population(fact(spark, base))
    bat = rows.groupBy(F.col("batter").alias("player"), "start_year").agg(long(F.col("batter_runs")).alias("r"), long(F.col("legal_delivery")).alias("b"))
    bowl = rows.groupBy(F.col("bowler").alias("player"), "start_year").agg(long(F.col("conceded")).alias("r"), long(F.col("bowler_ball")).alias("b"))
    every = bat.withColumn("measure", F.lit("strike_rate")).unionByName(bowl.withColumn("measure", F.lit("economy"))).where(F.col("b") >= min_balls)
    every = durable(every.withColumn("v", F.col("r") / F.col("b")))
    ranked = durable(rank_percentiles(every, ["measure", "start_year"], "v", "p"))
    top = ranked.groupBy("measure").agg(F.max("p").alias("top"))
    ranked = ranked.join(F.broadcast(top), "measure").withColumn("p", F.when(F.col("top") > 1.5, F.col("p") / 100).otherwise(F.col("p")))
    later = ranked.select("measure", "player", (F.col("start_year") - lag).alias("start_year"), F.col("p").alias("q"))
    pairs = durable(ranked.join(later, ["measure", "player", "start_year"]).select("measure", "p", "q"))
    both = rank_percentiles(durable(rank_percentiles(pairs, ["measure"], "p", "ra")), ["measure"], "q", "rb")
    sign = both.groupBy("measure").agg(F.round(F.corr("ra", "rb"), 9).alias("spearman"))
    j = both.join(F.broadcast(sign), "measure").withColumn("guess", F.when(F.col("spearman") < 0, 1 - F.col("p")).otherwise(F.col("p")))
    return j.groupBy("measure").agg(
        F.count("*").alias("n_pairs"), F.round(F.first("spearman"), 5).alias("spearman"), F.round(F.avg(F.abs(F.col("guess") - F.col("q"))), 6).alias("identity_mae"),
        F.round(F.avg(F.abs(F.lit(0.5) - F.col("q"))), 6).alias("constant_mae"),
    )


def recent_form(spark: SparkSession, base: str, window: int = 2) -> DataFrame:
    """Point in time: each player-season with the player's runs and balls of the ``window`` seasons before it."""
    g = league_batting(spark, base).groupBy("player", "start_year").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls"))
    a, b = g.alias("a"), g.select(F.col("player").alias("p2"), F.col("start_year").alias("y2"), F.col("runs").alias("r2"), F.col("balls").alias("b2"))
    j = a.join(b, (F.col("player") == F.col("p2")) & (F.col("y2") < F.col("start_year")) & (F.col("y2") >= F.col("start_year") - window), "left")
    return j.groupBy("player", "start_year").agg(F.coalesce(F.sum("r2"), F.lit(0)).alias("prior_runs"), F.coalesce(F.sum("b2"), F.lit(0)).alias("prior_balls"), F.count("y2").alias("prior_seasons"))


def season_lag(spark: SparkSession, base: str, lag: int = 1) -> DataFrame:
    """A season's rank percentile against the same player's ``lag`` seasons later: Spearman and absolute error."""
    g = league_batting(spark, base).groupBy("player", "start_year").agg(F.sum("runs").alias("runs"), F.sum("balls").alias("balls")).where("balls >= 4")
    g = g.withColumn("sr", F.col("runs") / F.col("balls"))
    later = g.select("player", (F.col("start_year") - lag).alias("start_year"), F.col("sr").alias("next"))
    j = g.join(later, ["player", "start_year"]).select("start_year", "player", "sr", "next")
    ranked = j.withColumns({"ra": average_rank_pct(F.col("sr"), ["start_year"]), "rb": average_rank_pct(F.col("next"), ["start_year"])})
    return ranked.groupBy("start_year").agg(F.count("*").alias("n_pairs"), F.round(F.when((F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0), F.corr("ra", "rb")), 5).alias("spearman"), F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 6).alias("mae"), F.round(F.sqrt(F.avg(F.pow(F.col("ra") - F.col("rb"), 2))), 6).alias("rmse"))


def best_season(spark: SparkSession, base: str) -> DataFrame:
    """The season with most runs of each player (ties: the later), the league played most, and the last one active."""
    g = league_batting(spark, base)
    s = g.groupBy("player", "start_year").agg(F.sum("runs").alias("runs"))
    best = s.groupBy("player").agg(F.max_by("start_year", F.struct("runs", "start_year")).alias("best_season"), F.max("runs").alias("best_runs"), F.max("start_year").alias("last_active"))
    league = g.groupBy("player", "competition").agg(F.sum("balls").alias("balls")).groupBy("player").agg(F.max_by("competition", F.struct("balls", "competition")).alias("main_league"), F.array_join(F.array_sort(F.collect_set("competition")), "|").alias("leagues"))
    return best.join(league, "player")


QUERIES = {
    "f23_league_factors": league_factors, "f25_adjusted": adjusted, "f20_translation": translation, "f22_uncapped": uncapped, "f19_cohort": crossover_cohort, "j10_recent_form": recent_form,
    "j12_season_lag": season_lag, "a19_best_season": best_season, "f24_applied": factors_applied, "f37_translation": translation_features, "f19_summary": cohort_summary, "m06_identity": identity_baseline,
}

LEAGUE_SQL = """
, ev as (select *, list_filter(list_transform(string_split(dismissal_player_out, '|'), lambda x: trim(x)), lambda x: x <> '') ps,
        list_filter(list_transform(string_split(dismissal_type, '|'), lambda x: lower(trim(x))), lambda x: x <> '') ks from pop where dismissal_player_out is not null),
ex as (select competition, start_year, unnest(ps) player, generate_subscripts(ps, 1) i, ks from ev),
ou as (select competition, start_year, player, count(*) outs from ex where coalesce(ks[i], ks[-1], 'unknown') not in ('retired hurt', 'retired not out') group by all),
lr as (select competition, start_year, batter player, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls from pop group by all),
lb as (select lr.*, coalesce(outs, 0) outs from lr left join ou using (competition, start_year, player)),
wb as (select competition, batter player, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls, count(*) filter (is_wicket = 1 and dismissal_player_out = batter) outs from pop group by all),
ww as (select competition, bowler player, sum(conceded)::bigint runs, sum(bowler_ball)::bigint balls from pop group by all),
qb as (select competition, player, runs / outs rate from wb where outs >= 1 and runs > 0), qw as (select competition, player, 6 * (runs / balls) rate from ww where balls >= 12 and runs > 0),
rb as (select a.competition, avg(a.rate / h.rate) ratio, count(*) n from qb a join qb h using (player) where h.competition = 'ipl' and a.competition <> 'ipl' group by 1),
rw as (select a.competition, avg(a.rate / h.rate) ratio, count(*) n from qw a join qw h using (player) where h.competition = 'ipl' and a.competition <> 'ipl' group by 1),
lf as (select c.competition, coalesce(rb.n, 0)::bigint n_batting, round(case when c.competition = 'ipl' then 1 else rb.ratio end, 5) batting_ratio, round(case when c.competition = 'ipl' then 1 else 1 / rb.ratio end, 5) batting_factor,
        coalesce(rw.n, 0)::bigint n_bowling, round(case when c.competition = 'ipl' then 1 else rw.ratio end, 5) bowling_ratio, round(case when c.competition = 'ipl' then 1 else 1 / rw.ratio end, 5) bowling_factor
        from (select distinct competition from pop) c left join rb using (competition) left join rw using (competition))
"""
SQL = {
    "f23_league_factors": sql(f"{LEAGUE_SQL} select * from lf"),
    "f25_adjusted": sql(f"""{LEAGUE_SQL}, a as (select player, sum(runs)::bigint runs, sum(outs)::bigint outs, coalesce(sum(runs * batting_factor), 0) w from wb left join lf using (competition) group by 1),
        b as (select player, sum(runs)::bigint conceded, sum(balls)::bigint balls, coalesce(sum(runs * bowling_factor), 0) w from ww left join lf using (competition) group by 1)
        select player, runs, outs, round(a.w / nullif(outs, 0), 3) adjusted_average, conceded, balls, round(6 * (b.w / nullif(balls, 0)), 3) adjusted_economy from a full join b using (player)"""),
    "f24_applied": sql("""select scope, player, start_year, a.f batting_factor, b.f bowling_factor from (select distinct scope, batter player, start_year, case when scope = 'ipl' then 1.0::double end f from scoped) a
        full join (select distinct scope, bowler player, start_year, case when scope = 'ipl' then 1.0::double end f from scoped) b using (scope, player, start_year)"""),
    "f37_translation": sql(f"""{LEAGUE_SQL}, ba as (select player, start_year, balls, case when balls >= 12 then 100 * runs / balls end x, case when balls >= 12 then runs / nullif(outs, 0) end y from lb where competition = 'sma'),
        bo as (select bowler player, start_year, sum(bowler_ball)::bigint balls, sum(conceded) r, sum(is_credited) w from pop where competition = 'sma' group by all),
        bw as (select player, start_year, balls, case when balls >= 12 then 6 * r / balls end x, case when balls >= 12 then 6 * w / balls end y from bo),
        lo as (select 'strike_rate' m, 1 s, player, start_year, x v from ba union all select 'average', 1, player, start_year, y from ba union all select 'economy', -1, player, start_year, x from bw union all select 'wicket_rate', 1, player, start_year, y from bw),
        rk as (select *, case when v is not null then (rank() over (partition by m, start_year order by s * v nulls last) + (count(*) over (partition by m, start_year, v) - 1) / 2) / count(v) over (partition by m, start_year) end p,
            avg(v) over (partition by m, start_year) mu from lo),
        va as (select m, player, round(var_pop(v), 12) z from lo where v is not null group by 1, 2 having count(*) >= 2), md as (select m, median(z) k from va group by 1),
        fl as (select m, player, z > k g from va join md using (m)), o as (select rk.*, case when mu > 0 then v / mu end d, g from rk left join fl using (m, player)),
        t as (select m, player, start_year, round(v, 6) v, round(p, 6) p, round(d, 6) d, g from o)
        select ba.player, ba.start_year, 'batting' player_type, balls, a.v strike_rate, b.v average, a.p strike_rate_percentile, a.d strike_rate_dominance, a.g strike_rate_variance_flag, b.p average_percentile, b.d average_dominance, b.g average_variance_flag,
            null::double economy, null::double wicket_rate, null::double economy_percentile, null::double economy_dominance, null::boolean economy_variance_flag, null::double wicket_rate_percentile, null::double wicket_rate_dominance, null::boolean wicket_rate_variance_flag
            from ba join t a on a.m = 'strike_rate' and a.player = ba.player and a.start_year = ba.start_year join t b on b.m = 'average' and b.player = ba.player and b.start_year = ba.start_year
        union all select bw.player, bw.start_year, 'bowling', balls, null, null, null, null, null, null, null, null, a.v, b.v, a.p, a.d, a.g, b.p, b.d, b.g
            from bw join t a on a.m = 'economy' and a.player = bw.player and a.start_year = bw.start_year join t b on b.m = 'wicket_rate' and b.player = bw.player and b.start_year = bw.start_year"""),
    "f20_translation": sql(f"""{LEAGUE_SQL}, g as (select *, case when balls >= 12 then 100 * runs / balls end sr from lb where competition = 'sma'),
        r as (select *, case when sr is not null then (rank() over (partition by start_year order by sr nulls last) + (count(*) over (partition by start_year, sr) - 1) / 2) / count(sr) over (partition by start_year) end p, avg(sr) over (partition by start_year) mu from g),
        v as (select player, var_pop(sr) v from g where sr is not null group by 1 having count(*) >= 2), f as (select player, v > (select median(v) from v) variance_flag from v)
        select player, start_year, balls, round(sr, 4) strike_rate, round(p, 6) percentile, round(case when mu > 0 then sr / mu end, 6) dominance, variance_flag from r left join f using (player)"""),
    "f22_uncapped": sql(", p as (select competition, batter player from pop union select competition, bowler from pop) select distinct player from p where competition = 'sma' and player not in (select player from p where competition = 'ipl')"),
    "f19_cohort": sql(f"""{LEAGUE_SQL}, t as (select player, start_year, case when competition = 'ipl' then 'main' else 'other' end tier, sum(runs) runs, sum(balls) balls from lb group by all),
        n as (select distinct d.player from t d join t i on i.player = d.player and abs(i.start_year - d.start_year) <= 1 where d.tier = 'other' and i.tier = 'main'),
        p as (select player, sum(runs) filter (tier = 'main') mr, sum(balls) filter (tier = 'main') mb, sum(runs) filter (tier = 'other') orr, sum(balls) filter (tier = 'other') ob from t where player in (select player from n) group by 1)
        select player, mb::bigint main_balls, ob::bigint other_balls, round((mr / mb) / (orr / ob), 5) ratio from p where mb >= 6 and ob >= 6 and orr > 0"""),
    "j10_recent_form": sql(f"""{LEAGUE_SQL}, g as (select player, start_year, sum(runs) runs, sum(balls) balls from lb group by all)
        select a.player, a.start_year, coalesce(sum(b.runs), 0)::bigint prior_runs, coalesce(sum(b.balls), 0)::bigint prior_balls, count(b.start_year) prior_seasons from g a left join g b on a.player = b.player and b.start_year < a.start_year and b.start_year >= a.start_year - 2 group by 1, 2"""),
    "j12_season_lag": sql(f"""{LEAGUE_SQL}, g as (select player, start_year, sum(runs) / sum(balls) sr from lb group by all having sum(balls) >= 4),
        j as (select a.start_year, a.player, a.sr, b.sr nx from g a join g b on a.player = b.player and b.start_year = a.start_year + 1),
        r as (select start_year, (rank() over (partition by start_year order by sr) + (count(*) over (partition by start_year, sr) - 1) / 2) / count(*) over (partition by start_year) ra,
        (rank() over (partition by start_year order by nx) + (count(*) over (partition by start_year, nx) - 1) / 2) / count(*) over (partition by start_year) rb from j)
        select start_year, count(*) n_pairs, round(case when stddev_pop(ra) > 0 and stddev_pop(rb) > 0 then corr(ra, rb) end, 5) spearman, round(avg(abs(ra - rb)), 6) mae, round(sqrt(avg(power(ra - rb, 2))), 6) rmse from r group by 1"""),
    "a19_best_season": sql(f"""{LEAGUE_SQL}, s as (select player, start_year, sum(runs)::bigint runs from lb group by all), b as (select player, max_by(start_year, (runs, start_year)) best_season, max(runs) best_runs, max(start_year) last_active from s group by 1),
        c as (select player, competition, sum(balls) balls from lb group by all), l as (select player, max_by(competition, (balls, competition)) main_league, string_agg(distinct competition, '|' order by competition) leagues from c group by 1) select * from b join l using (player)"""),
}
SQL["f19_summary"] = f"""with c as ({SQL['f19_cohort']}) select count(*) n_players, round(avg(ratio), 5) mean_ratio, round(median(ratio), 5) median_ratio, count(*) >= 30 is_enough from c"""
SQL["m06_identity"] = sql("""select 1""").rsplit("select 1", 1)[0].rstrip() + """, ev as (select 'strike_rate' measure, batter player, start_year, sum(batter_runs) / sum(legal_delivery) v from pop group by all having sum(legal_delivery) >= 4
    union all select 'economy', bowler, start_year, sum(conceded) / sum(bowler_ball) from pop group by all having sum(bowler_ball) >= 4),
 rk as (select *, (rank() over (partition by measure, start_year order by v) + (count(*) over (partition by measure, start_year, v) - 1) / 2) / count(*) over (partition by measure, start_year) p from ev),
 pr as (select a.measure, a.p, b.p q from rk a join rk b on a.measure = b.measure and a.player = b.player and b.start_year = a.start_year + 1),
 rr as (select *, (rank() over (partition by measure order by p) + (count(*) over (partition by measure, p) - 1) / 2) ra, (rank() over (partition by measure order by q) + (count(*) over (partition by measure, q) - 1) / 2) rb from pr),
 sp as (select measure, round(corr(ra, rb), 9) c from rr group by 1)
 select measure, count(*) n_pairs, round(max(c), 5) spearman, round(avg(abs(case when c < 0 then 1 - p else p end - q)), 6) identity_mae, round(avg(abs(0.5::double - q)), 6) constant_mae from pr join sp using (measure) group by 1"""
