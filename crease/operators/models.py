"""Linear models by sufficient statistics, and the fair-value index of player seasons.

A linear model needs only the sums of products of its columns: one distributed pass gives a matrix as small as the
number of features, and the driver solves it. Imputation and scaling are aggregates of the same kind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.errors import ContractError
from crease.functions.prefix import medians, rank_percentiles
from crease.functions.scalars import safe_div
from crease.operators.auction import SALES_SQL, TRAIN_TO, VALID_TO, price_features, rupees, sales
from crease.operators.facts import FACT_SQL, fact, long, population, sql
from crease.operators.features import dismissals
from crease.operators.identity import IDS_SQL, NAME_KEY, UNRESOLVED, kept_mapping, resolve, resolved_fact
from crease.operators.leagues import BASELINE, LEAGUE_SQL, league_factors
from crease.sources.tables import bounded_rows, durable

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def gram(rows: DataFrame, columns: list[Column]) -> np.ndarray:
    """The matrix of sums of products of the columns, from one aggregate."""
    k = len(columns)
    sums = [F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    one = rows.agg(*sums).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = one[f"s{i}_{j}"] or 0.0
    return out


def column_medians(rows: DataFrame, features: list[str]) -> dict[str, float | None]:
    """The exact median of each feature, None where all its values are NULL; one row for each feature reaches the driver."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in features])).alias("x"))
    got = {r["c"]: r["m"] for r in medians(stacked.select("x.c", "x.v"), ["c"], "v", "m").collect()}
    return {c: got.get(c) for c in features}


def ridge(rows: DataFrame, features: list[str], target: str, alphas: tuple[float, ...] = ALPHAS) -> dict[float, Column]:
    """alpha -> prediction column. NULL features take the median (0 if all are NULL); features are standardised.

    Solves (Z'Z + alpha I) w = Z'(y - mean y). One pass for the medians, one for the Gram matrix of all alphas.
    """
    med = column_medians(rows, features)
    filled = [F.coalesce(F.col(c), F.lit(float(med[c]) if med[c] is not None else 0.0)) for c in features]
    g = gram(rows, [F.lit(1.0), *filled, F.col(target)])
    n, p = g[0, 0], len(features)
    if n == 0:
        return {a: F.lit(None).cast("double") for a in alphas}
    mean = g[0, 1 : p + 1] / n
    sd = np.sqrt(np.maximum(np.diag(g)[1 : p + 1] / n - mean**2, 0.0))
    sd[sd < 1e-12] = 1.0
    centred = g[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
    z = centred / np.outer(sd, sd)
    y_mean = g[0, p + 1] / n
    zy = (g[1 : p + 1, p + 1] - n * mean * y_mean) / sd
    out = {}
    for a in alphas:
        w = np.linalg.solve(z + a * np.eye(p), zy) / sd
        prediction = F.lit(float(y_mean - w @ mean))
        for c, x in zip(filled, w):
            prediction = prediction + c * F.lit(float(x))
        out[a] = prediction
    return out


def ridge_report(spark: SparkSession, base: str) -> DataFrame:
    """Error on the validation years for each alpha, fitted on the years before."""
    f = price_features(spark, base)
    predictions = ridge(f.where(F.col("year") <= TRAIN_TO), ["prev_log_price", "gap", "has_prev", "market"], "y")
    valid = f.where((F.col("year") > TRAIN_TO) & (F.col("year") <= VALID_TO))
    rows = valid.select("y", *[p.alias(str(a)) for a, p in predictions.items()]).unpivot(["y"], [f"`{a}`" for a in predictions], "alpha", "p")
    return rows.groupBy("alpha").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("log_mae"), F.round(F.avg(F.abs(F.expm1("p") - F.expm1("y"))), 2).alias("mae"))


PRICE_FEATURES = ["prev_log_price", "gap", "has_prev", "market"]


def solved(g: np.ndarray, alphas: tuple[float, ...]) -> dict[float, tuple[float, np.ndarray]]:
    """alpha -> (intercept, weights) of a ridge fit from the Gram matrix of (1, features, target)."""
    n, p = g[0, 0], g.shape[0] - 2
    mean = g[0, 1 : p + 1] / n
    sd = np.sqrt(np.maximum(np.diag(g)[1 : p + 1] / n - mean**2, 0.0))
    sd[sd < 1e-12] = 1.0
    z = (g[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
    y_mean = g[0, p + 1] / n
    zy = (g[1 : p + 1, p + 1] - n * mean * y_mean) / sd
    out = {}
    for a in alphas:
        w = np.linalg.solve(z + a * np.eye(p), zy) / sd
        out[a] = float(y_mean - w @ mean), w
    return out


def alpha_by_folds(rows: DataFrame, features: list[str], target: str, first: int, last: int, least: int = 50, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(alpha, n, cv_log_mae, is_best): the error of each alpha over expanding windows.

    For each year from ``first`` to ``last`` the rows before it are fitted on and those of it are scored; a fold of fewer
    than ``least`` rows is left out. One pass gives the Gram matrices of all folds; medians are those of the fold.
    """
    rows = durable(rows.select("year", *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("y_")))
    folds = rows.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("year") + 1, F.lit(first)), F.lit(last)))).where(F.col("year") < F.col("fold"))
    stacked = folds.select("fold", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in features])).alias("x")).select("fold", "x.c", "x.v")
    med = {(r["fold"], r["c"]): r["m"] for r in medians(stacked, ["fold", "c"], "v", "m").collect()}
    years = range(first, last + 1)
    by_fold = lambda values: F.element_at(F.create_map(*[x for y in years for x in (F.lit(y).cast("bigint"), F.lit(float(values(y))))]), F.col("fold").cast("bigint"))
    filled = [F.coalesce(F.col(c), by_fold(lambda y, c=c: med.get((y, c)) or 0.0)) for c in features]
    columns = [F.lit(1.0), *filled, F.col("y_")]
    k = len(columns)
    sums = folds.groupBy("fold").agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).collect()
    fits: dict[int, dict] = {}
    for r in sums:
        g = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        if g[0, 0] >= least:
            fits[r["fold"]] = solved(g, alphas)
    tested = rows.withColumn("fold", F.col("year")).where(F.col("fold").isin(*fits) if fits else F.lit(False))
    made = []
    for a in alphas:
        weight = lambda y, i, a=a: (fits[y][a][0] if i < 0 else fits[y][a][1][i]) if y in fits else 0.0
        p = by_fold(lambda y: weight(y, -1))
        for i, x in enumerate(filled):
            p = p + x * by_fold(lambda y, i=i: weight(y, i))
        made.append(F.struct(F.lit(float(a)).alias("alpha"), F.abs(p - F.col("y_")).alias("e")))
    errors = tested.select(F.explode(F.array(*made)).alias("x")).select("x.*").groupBy("alpha").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("cv_log_mae"))
    best = errors.agg(F.min(F.struct("cv_log_mae", "alpha")).alias("b")).select(F.col("b.alpha").alias("best"))
    return errors.crossJoin(F.broadcast(best)).select("alpha", "n", "cv_log_mae", (F.col("alpha") == F.col("best")).alias("is_best"))


def alpha_report(spark: SparkSession, base: str) -> DataFrame:
    return alpha_by_folds(price_features(spark, base).where(F.col("year") <= TRAIN_TO), PRICE_FEATURES, "y", 2018, TRAIN_TO, least=20)


def one_hot(df: DataFrame, column: str, most: int = 1000) -> tuple[list[str], list[Column]]:
    """(levels, indicator columns): the sorted levels of a column but the first; NULL and the first are zero everywhere.

    A level is a column of the result, so there is a bound, and more levels are an error.
    """
    rows = bounded_rows(df.select(column).where(F.col(column).isNotNull()).distinct(), most)
    if rows is None:
        raise ContractError(f"{column} has more than {most} levels")
    levels = sorted(r[0] for r in rows)[1:]
    return levels, [F.when(F.col(column) == x, 1.0).otherwise(0.0) for x in levels]


def level_counts(spark: SparkSession, base: str) -> DataFrame:
    """The lots' roles one-hot encoded: for each level but the first, the number of rows that have it."""
    rows = sales(spark, base)
    levels, hot = one_hot(rows, "role")
    if not levels:
        return rows.select(F.col("role").alias("level"), F.lit(0).cast("bigint").alias("n_rows")).where("false")
    made = F.array(*[F.struct(F.lit(x).alias("level"), h.alias("v")) for x, h in zip(levels, hot)])
    return rows.select(F.explode(made).alias("x")).groupBy("x.level").agg(F.sum("x.v").cast("bigint").alias("n_rows"))


def least_squares(rows: DataFrame, columns: list[Column], target: Column) -> Column:
    """The least-squares prediction of ``target``, at least 0; a matrix as large as the columns reaches the driver."""
    g = gram(rows, [*columns, target])
    k = len(columns)
    w = np.linalg.lstsq(g[:k, :k], g[:k, k], rcond=None)[0]
    p = F.lit(0.0)
    for c, x in zip(columns, w):
        p = p + c * F.lit(float(x))
    return F.greatest(p, F.lit(0.0))


def ols_report(spark: SparkSession, base: str) -> DataFrame:
    """Least squares of the price on year and one-hot role; errors and R2 by role, and how many lots are underpriced."""
    rows = rupees(spark, base)
    _, hot = one_hot(rows, "role")
    p = least_squares(rows, [F.lit(1.0), (F.col("year") - 2020).cast("double"), *hot], F.col("price"))
    scored = rows.withColumn("p", p)
    mean = rows.agg(F.avg("price").alias("mean"))
    e = F.col("p") - F.col("price")
    return scored.crossJoin(F.broadcast(mean)).groupBy("role").agg(
        F.count("*").alias("n"), F.round(F.avg("p"), 2).alias("mean_predicted"), F.round(F.avg(F.abs(e)), 2).alias("mae"),
        F.round(1 - F.sum(e * e) / F.sum(F.pow(F.col("price") - F.col("mean"), 2)), 5).alias("r2"), F.count_if(e > 0).alias("n_underpriced"),
    )


def year_line(spark: SparkSession, base: str) -> DataFrame:
    """Least squares of the price on the year alone, by role: slope, intercept and number of lots, in closed form."""
    y = (F.col("year") - 2020).cast("double")
    g = rupees(spark, base).groupBy("role").agg(F.count("*").alias("n"), F.regr_slope("price", y).alias("slope"), F.regr_intercept("price", y).alias("intercept"))
    return g.select("role", "n", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"))


def performance_features(spark: SparkSession, base: str, window: int = 2, min_bat: int = 6, min_bowl: int = 6) -> DataFrame:
    """What was known of a sold player's play before the sale: sums over the ``window`` seasons before the year, rates
    where there were enough balls, and the main league's balls of all seasons before."""
    lots = resolve(sales(spark, base).where("player_name is not null").select("player_name", "year"), "player_name", kept_mapping(spark, base))
    keys = lots.where(~F.col("player_name_canonical_id").isin(UNRESOLVED, "NA")).select(F.col("player_name_canonical_id").alias("player_id"), "year").distinct()
    rows = resolved_fact(spark, base)
    home = F.when(F.col("competition") == BASELINE, 1).otherwise(0)
    bat = rows.groupBy(F.col("batter_id").alias("id"), "start_year").agg(long(F.col("batter_runs")).alias("r"), long(F.col("legal_delivery")).alias("b"), long(F.col("legal_delivery") * home).alias("h"))
    bowl = rows.groupBy(F.col("bowler_id").alias("id"), "start_year").agg(long(F.col("conceded")).alias("r2"), long(F.col("bowler_ball")).alias("b2"), long(F.col("is_credited")).alias("w2"), long(F.col("bowler_ball") * home).alias("h2"))
    seasons = durable(bat.join(bowl, ["id", "start_year"], "full"))
    j = keys.join(seasons, (F.col("player_id") == F.col("id")) & (F.col("start_year") < F.col("year")), "left")
    recent = F.col("start_year") >= F.col("year") - window
    of = lambda c: F.coalesce(F.sum(F.when(recent, F.col(c))), F.lit(0)).alias(c)
    ever = F.coalesce(F.sum(F.coalesce("h", F.lit(0)) + F.coalesce("h2", F.lit(0))), F.lit(0)).alias("h")
    g = j.groupBy("player_id", "year").agg(*[of(c) for c in ("r", "b", "r2", "b2", "w2")], ever)
    rate = lambda x, n, k, least: F.round(F.when(F.col(n) >= least, k * F.col(x) / F.col(n)), 6)
    return g.select(
        "player_id", "year", F.round(F.log1p("b"), 6).alias("log_bat_balls"), rate("r", "b", 100, min_bat).alias("bat_strike_rate"), F.round(F.log1p("b2"), 6).alias("log_bowl_balls"),
        rate("r2", "b2", 6, min_bowl).alias("bowl_economy"), rate("w2", "b2", 24, min_bowl).alias("bowl_wickets_24"), F.round(F.log1p("h"), 6).alias("log_main_balls"),
        (F.col("b") + F.col("b2") > 0).alias("has_prior"),
    )


def cells(spark: SparkSession, base: str) -> DataFrame:
    """Player, season, league and phase: runs, balls and wickets of either discipline."""
    rows = population(fact(spark, base), gender=None)
    keys = ["start_year", "competition", "phase"]
    bat = rows.groupBy(F.col("batter").alias("player"), *keys).agg(long(F.col("batter_runs")).alias("runs"), long(F.col("legal_delivery")).alias("balls"), F.lit(0).cast("bigint").alias("wickets")).withColumn("discipline", F.lit("bat"))
    given = F.col("batter_runs") + F.coalesce("wides_runs", F.lit(0)) + F.coalesce("noballs_runs", F.lit(0))
    bowl = rows.groupBy(F.col("bowler").alias("player"), *keys).agg(long(given).alias("runs"), long(F.col("bowler_ball")).alias("balls"), long(F.col("is_credited")).alias("wickets")).withColumn("discipline", F.lit("bowl"))
    return bat.unionByName(bowl)


#: Balls that qualify a season (100 and 60 suit full tables); scarcity weight, wicket weight and the bounds of a multiplier.
QUALIFIED, LAMBDA, WICKET_SCALE, LOW, HIGH = 24, 0.5, 0.5, 0.8, 1.5
#: The settings of the sensitivity report: name, lambda, wicket scale, whose number is the supply of a role.
SETTINGS = (("default", LAMBDA, WICKET_SCALE, "all"), ("lambda 0.25", 0.25, WICKET_SCALE, "all"), ("lambda 1", 1.0, WICKET_SCALE, "all"), ("wickets 0.25", LAMBDA, 0.25, "all"),
            ("wickets 1", LAMBDA, 1.0, "all"), ("quality", LAMBDA, WICKET_SCALE, "quality"))


def impact(spark: SparkSession, base: str, settings: tuple = SETTINGS[:1]) -> DataFrame:
    """Step 2: the impact of each cell (player, season, league, phase, discipline) under each setting.

    Batting: runs times the league's factor, less the balls at the main league's rate of the season and phase, less the
    dismissals beyond its rate at a share of the runs that a wicket is worth in the phase. Bowling is the mirror image.
    A phase weighs as its runs a ball to those of all. Where the main league has no balls in a season and phase, the
    rates of all leagues and seasons in that phase stand in; an unknown factor is 1.
    """
    c = cells(spark, base)
    rows = population(fact(spark, base), gender=None)
    gone = dismissals(rows, ["start_year", "competition", "phase"]).where(~F.col("kind").isin("retired hurt", "retired not out"))
    gone = gone.groupBy("player", "start_year", "competition", "phase").agg(F.count("*").alias("gone")).withColumn("discipline", F.lit("bat"))
    c = c.join(gone, ["player", "start_year", "competition", "phase", "discipline"], "left")
    c = durable(c.withColumn("events", F.when(F.col("discipline") == "bat", F.coalesce("gone", F.lit(0))).otherwise(F.col("wickets"))).drop("gone", "wickets"))
    sums = [F.sum(x).alias(x) for x in ("runs", "balls", "events")]
    main = c.where(F.col("competition") == BASELINE)
    rates = lambda g, tag: g.withColumns({f"base{tag}": safe_div(F.col("runs"), F.col("balls"), None), f"event{tag}": safe_div(F.col("events"), F.col("balls"), None)}).drop("runs", "balls", "events")
    season = rates(main.groupBy("discipline", "start_year", "phase").agg(*sums), "_s")
    everywhere = rates(c.groupBy("discipline", "phase").agg(*sums), "_a")
    in_phase = main.groupBy("discipline", "phase").agg(*sums)
    over_all = main.groupBy("discipline").agg(F.sum("runs").alias("all_runs"), F.sum("balls").alias("all_balls"))
    weight = in_phase.join(over_all, "discipline").where("discipline = 'bat'").select("phase", safe_div(F.col("runs") / F.col("balls"), F.col("all_runs") / F.col("all_balls"), None).alias("w"))
    worth = in_phase.where("discipline = 'bowl'").select("phase", safe_div(F.col("runs"), F.col("events"), None).alias("v"))
    factors = league_factors(spark, base).select("competition", "batting_factor", "bowling_factor")
    j = c.join(season, ["discipline", "start_year", "phase"], "left").join(everywhere, ["discipline", "phase"], "left")
    j = j.join(F.broadcast(weight), "phase", "left").join(F.broadcast(worth), "phase", "left").join(F.broadcast(factors), "competition", "left")
    configs = spark.createDataFrame([x[:1] + x[2:3] for x in settings], "config string, ws double")
    rate, event = F.coalesce("base_s", "base_a", F.lit(0.0)), F.coalesce("event_s", "event_a", F.lit(0.0))
    factor = F.coalesce(F.when(F.col("discipline") == "bat", F.col("batting_factor")).otherwise(F.col("bowling_factor")), F.lit(1.0))
    gained = F.col("runs") * factor - F.col("balls") * rate
    lost = F.col("ws") * F.coalesce("v", F.lit(0.0)) * (F.col("events") - F.col("balls") * event)
    value = F.when(F.col("discipline") == "bat", gained - lost).otherwise(lost - gained)
    return j.crossJoin(F.broadcast(configs)).select("config", "player", "start_year", "competition", "phase", "discipline", "balls", value.alias("impact"), F.coalesce("w", F.lit(1.0)).alias("w"))


def scarcity(long_rows: DataFrame, settings: tuple = SETTINGS[:1], q: int = QUALIFIED) -> DataFrame:
    """Step 3: for each season, discipline and phase of the main league how scarce its players are.

    Demand is the discipline's balls over the qualification; supply the players with their part of it in the phase (with
    positive impact where quality counts). The ratio, over its median, gives a multiplier within bounds.
    """
    key = ["config", "start_year", "discipline", "phase"]
    main = long_rows.where(F.col("competition") == BASELINE).groupBy(*key, "player").agg(F.sum("balls").alias("balls"), F.sum("impact").alias("impact"))
    cell = main.groupBy(*key).agg(F.sum("balls").alias("cell_balls"))
    total = cell.groupBy("config", "start_year", "discipline").agg(F.sum("cell_balls").alias("disc_balls"))
    cell = cell.join(total, ["config", "start_year", "discipline"]).where("disc_balls > 0")
    ok = main.join(cell, key).where(F.col("balls") >= q * F.col("cell_balls") / F.col("disc_balls"))
    n = ok.groupBy(*key).agg(F.count("*").alias("n_qualified"), F.count_if(F.col("impact") > 0).alias("n_positive"))
    configs = long_rows.sparkSession.createDataFrame([(x[0], float(x[1]), x[3]) for x in settings], "config string, lam double, mode string")
    j = cell.join(n, key, "left").na.fill(0, ["n_qualified", "n_positive"]).join(F.broadcast(configs), "config")
    supply = F.greatest(F.when(F.col("mode") == "quality", F.col("n_positive")).otherwise(F.col("n_qualified")), F.lit(1))
    j = durable(j.withColumn("s", F.round(F.col("disc_balls") / q / supply, 9)))
    j = j.join(medians(j, ["config"], "s", "middle"), "config").withColumn("s_norm", F.col("s") / F.col("middle"))
    mult = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), 1 + F.col("lam") * (F.col("s_norm") - 1)))
    return j.select(*key, "n_qualified", "n_positive", "s_norm", "lam", mult.alias("mult"))


def index(long_rows: DataFrame, scarce: DataFrame, q: int = QUALIFIED) -> DataFrame:
    """Step 4: the 0-100 index of each player season, with its core (before scarcity), balls and main discipline.

    Weighted impact by discipline over the deviation of qualified seasons, less their median for as much of the
    qualification as was played; both disciplines add up to z, the core is 100 / (1 + exp(-z / 2)), and the value is the
    core times the multiplier of the phases played, weighted by balls. A phase without a multiplier has 1.
    """
    key = ["config", "player", "start_year"]
    x = long_rows.groupBy(*key, "discipline", "phase").agg(F.sum("balls").alias("balls"), F.sum(F.col("impact") * F.col("w")).alias("wimp")).where("balls > 0")
    x = x.join(scarce.select("config", "start_year", "discipline", "phase", "mult"), ["config", "start_year", "discipline", "phase"], "left").withColumn("bm", F.col("balls") * F.coalesce("mult", F.lit(1.0)))
    d = durable(x.groupBy(*key, "discipline").agg(F.round(F.sum("wimp"), 9).alias("wimp"), F.sum("balls").alias("balls"), F.sum("bm").alias("bm")))
    good = d.where(F.col("balls") >= q)
    scale = good.groupBy("config", "discipline").agg(F.stddev_pop("wimp").alias("sd"))
    scale = scale.join(medians(good, ["config", "discipline"], "wimp", "middle"), ["config", "discipline"])
    part = F.least(F.lit(1.0), F.col("balls") / q)
    z = d.join(scale, ["config", "discipline"], "left").withColumn("z", F.when(F.col("sd") > 0, F.col("wimp") / F.col("sd") - F.col("middle") / F.col("sd") * part).otherwise(0.0))
    g = z.groupBy(*key).agg(F.sum("z").alias("z"), F.sum("balls").alias("balls"), F.sum("bm").alias("bm"), F.max_by("discipline", F.struct("balls", "discipline")).alias("primary_discipline"), F.max((F.col("balls") >= q).cast("int")).alias("ok"))
    core = 100 / (1 + F.exp(-F.col("z") / 2))
    return g.select(*key, "balls", "primary_discipline", (F.col("ok") == 1).alias("qualified"), core.alias("core"), (core * F.col("bm") / F.col("balls")).alias("fair_value"))


def valued(spark: SparkSession, base: str, settings: tuple = SETTINGS[:1]) -> DataFrame:
    rows = durable(impact(spark, base, settings))
    return index(rows, scarcity(rows, settings))


def impact_report(spark: SparkSession, base: str) -> DataFrame:
    return impact(spark, base).select("player", "start_year", "competition", "phase", "discipline", "balls", F.round("impact", 4).alias("impact"), F.round("w", 6).alias("phase_weight"))


def scarcity_report(spark: SparkSession, base: str) -> DataFrame:
    rows = scarcity(durable(impact(spark, base)))
    return rows.select("start_year", "discipline", "phase", "n_qualified", "n_positive", F.round("s_norm", 6).alias("s_norm"), F.round("mult", 6).alias("mult"))


def fair_value(spark: SparkSession, base: str) -> DataFrame:
    return valued(spark, base).select("player", "start_year", "balls", "primary_discipline", "qualified", F.round("core", 3).alias("core_index"), F.round("fair_value", 3).alias("fair_value"))


def sensitivity(spark: SparkSession, base: str) -> DataFrame:
    """How far other settings order the qualified player seasons as the default does: rank correlation by setting. All
    settings are one pass over the cells."""
    rows = durable(valued(spark, base, SETTINGS).where("qualified").withColumn("fair_value", F.round("fair_value", 9)))
    default = rows.where("config = 'default'").select("player", "start_year", F.col("fair_value").alias("default_value"))
    pairs = durable(rows.where("config <> 'default'").join(default, ["player", "start_year"]))
    ranked = rank_percentiles(durable(rank_percentiles(pairs, ["config"], "fair_value", "a")), ["config"], "default_value", "b")
    return ranked.groupBy("config").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 5).alias("spearman"))


def fair_value_rank(spark: SparkSession, base: str, top: int = 10) -> DataFrame:
    w = Window.partitionBy("start_year").orderBy(F.desc("fair_value"), F.desc("balls"), "player")
    return fair_value(spark, base).where("balls >= 24").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


QUERIES = {
    "y03_ridge": ridge_report, "y05_ols": ols_report, "y06_cells": cells, "y09_fair_value": fair_value, "k02_fair_value_rank": fair_value_rank,
    "y02_performance": performance_features, "y04_alpha": alpha_report, "pred21_levels": level_counts, "y05_year_line": year_line, "y07_impact": impact_report, "y08_scarcity": scarcity_report, "y10_sensitivity": sensitivity,
}


CELLS_SQL = """pa as (select * from fact where start_year between 2018 and 2026 and not coalesce(is_super_over, false)),
 ce as (select batter player, start_year, competition, phase, sum(batter_runs)::bigint runs, sum(legal_delivery)::bigint balls, 0::bigint wickets, 'bat' discipline from pa group by all union all
        select bowler, start_year, competition, phase, sum(batter_runs + coalesce(wides_runs, 0) + coalesce(noballs_runs, 0))::bigint, sum(bowler_ball)::bigint, sum(is_credited)::bigint, 'bowl' from pa group by all)"""
FAIR_SQL = f"""{LEAGUE_SQL}, {CELLS_SQL}, cf(config, lam, ws, mode) as (values {", ".join(f"('{n}', {a}::double, {b}::double, '{m}')" for n, a, b, m in SETTINGS)}),
 pe as (select *, list_filter(list_transform(string_split(dismissal_player_out, '|'), lambda x: trim(x)), lambda x: x <> '') ps, list_filter(list_transform(string_split(dismissal_type, '|'), lambda x: lower(trim(x))), lambda x: x <> '') ks
        from pa where dismissal_player_out is not null),
 px as (select start_year, competition, phase, unnest(ps) player, generate_subscripts(ps, 1) i, ks from pe),
 pg as (select player, start_year, competition, phase, count(*) g from px where coalesce(ks[i], ks[-1], 'unknown') not in ('retired hurt', 'retired not out') group by all),
 ev2 as (select ce.* exclude (wickets), case when discipline = 'bat' then coalesce(g, 0) else wickets end events from ce left join pg on pg.player = ce.player and pg.start_year = ce.start_year and pg.competition = ce.competition and pg.phase = ce.phase and discipline = 'bat'),
 se as (select discipline, start_year, phase, sum(runs) / nullif(sum(balls), 0) bs, sum(events) / nullif(sum(balls), 0) es from ev2 where competition = 'ipl' group by all),
 an as (select discipline, phase, sum(runs) / nullif(sum(balls), 0) ba, sum(events) / nullif(sum(balls), 0) ea from ev2 group by all),
 ip as (select discipline, phase, sum(runs) r, sum(balls) b, sum(events) e from ev2 where competition = 'ipl' group by all),
 wt as (select phase, (r / b) / (sum(r) over () / sum(b) over ()) w from ip where discipline = 'bat'), vl as (select phase, r / nullif(e, 0) v from ip where discipline = 'bowl'),
 im as (select config, player, start_year, competition, phase, discipline, balls, coalesce(w, 1) w, runs * coalesce(case when discipline = 'bat' then batting_factor else bowling_factor end, 1) - balls * coalesce(bs, ba, 0) gained,
        ws * coalesce(v, 0) * (events - balls * coalesce(es, ea, 0)) lost from ev2 left join se using (discipline, start_year, phase) left join an using (discipline, phase) left join wt using (phase) left join vl using (phase) left join lf using (competition) cross join cf),
 il as (select *, case when discipline = 'bat' then gained - lost else lost - gained end impact from im),
 mi as (select config, start_year, discipline, phase, player, sum(balls) balls, sum(impact) impact from il where competition = 'ipl' group by all),
 cl as (select config, start_year, discipline, phase, sum(balls) cb from mi group by all), cd as (select *, sum(cb) over (partition by config, start_year, discipline) db from cl),
 oq as (select config, start_year, discipline, phase, count(*) nq, count(*) filter (impact > 0) np from mi join cd using (config, start_year, discipline, phase) where db > 0 and balls >= 24 * cb / db group by all),
 s1 as (select cd.*, coalesce(nq, 0) nq, coalesce(np, 0) np, lam, round(db / 24 / greatest(case when mode = 'quality' then coalesce(np, 0) else coalesce(nq, 0) end, 1), 9) s from cd left join oq using (config, start_year, discipline, phase) join cf using (config) where db > 0),
 s2 as (select *, s / median(s) over (partition by config) sn from s1), s3 as (select *, greatest(0.8::double, least(1.5::double, 1 + lam * (sn - 1))) mult from s2),
 xx as (select config, player, start_year, discipline, phase, sum(balls) balls, sum(impact * w) wimp from il group by all having sum(balls) > 0),
 xm as (select xx.*, balls * coalesce(mult, 1) bm from xx left join s3 using (config, start_year, discipline, phase)),
 dd as (select config, player, start_year, discipline, round(sum(wimp), 9) wimp, sum(balls) balls, sum(bm) bm from xm group by all),
 sc as (select config, discipline, median(wimp) middle, stddev_pop(wimp) sd from dd where balls >= 24 group by all),
 zz as (select dd.*, case when sd > 0 then wimp / sd - middle / sd * least(1, balls / 24) else 0 end z from dd left join sc using (config, discipline)),
 f0 as (select config, player, start_year, sum(balls)::bigint balls, max_by(discipline, (balls, discipline)) primary_discipline, max(balls) >= 24 or bool_or(balls >= 24) qualified, 100 / (1 + exp(-sum(z) / 2)) core, sum(bm) / sum(balls) m from zz group by 1, 2, 3),
 fv as (select player, start_year, balls, primary_discipline, qualified, round(core, 3) core_index, round(core * m, 3) fair_value from f0 where config = 'default')"""
PERF_SQL = f"""lo2 as (select distinct auction_year as year, nullif(trim(name_raw, ' '), '') n from (select distinct * exclude (loaded_at) from auction_lots)),
 ky as (select distinct coalesce(e.canonical_id, z.id) player_id, year from lo2 left join mp e on e.source_name = n left join nm z on z.k = {NAME_KEY("n")} and z.k <> '' where n is not null and coalesce(e.canonical_id, z.id) is not null),
 ba as (select batter_id id, start_year, sum(batter_runs) r, sum(legal_delivery) b, sum(case when competition = 'ipl' then legal_delivery else 0 end) h from rf group by all),
 bo as (select bowler_id id, start_year, sum(conceded) r2, sum(bowler_ball) b2, sum(is_credited) w2, sum(case when competition = 'ipl' then bowler_ball else 0 end) h2 from rf group by all),
 ss as (select * from ba full join bo using (id, start_year)),
 g as (select player_id, year, coalesce(sum(r) filter (start_year >= year - 2), 0) r, coalesce(sum(b) filter (start_year >= year - 2), 0) b, coalesce(sum(r2) filter (start_year >= year - 2), 0) r2, coalesce(sum(b2) filter (start_year >= year - 2), 0) b2,
   coalesce(sum(w2) filter (start_year >= year - 2), 0) w2, coalesce(sum(coalesce(h, 0) + coalesce(h2, 0)), 0) h from ky left join ss on ss.id = player_id and start_year < year group by 1, 2)"""
SQL = {
    "y06_cells": sql(f", {CELLS_SQL} select * from ce"),
    "y07_impact": sql(f"{FAIR_SQL} select player, start_year, competition, phase, discipline, balls, round(impact, 4) impact, round(w, 6) phase_weight from il where config = 'default'"),
    "y08_scarcity": sql(f"{FAIR_SQL} select start_year, discipline, phase, nq::bigint n_qualified, np::bigint n_positive, round(sn, 6) s_norm, round(mult, 6) mult from s3 where config = 'default'"),
    "y09_fair_value": sql(f"{FAIR_SQL} select * from fv"),
    "k02_fair_value_rank": sql(f"{FAIR_SQL} select * from (select *, row_number() over (partition by start_year order by fair_value desc, balls desc, player)::integer place from fv where balls >= 24) where place <= 10"),
    "y10_sensitivity": sql(f"""{FAIR_SQL}, q as (select config, player, start_year, round(core * m, 9) x from f0 where qualified), p as (select a.config, a.x, d.x y from q a join q d using (player, start_year) where d.config = 'default' and a.config <> 'default'),
        r as (select config, rank() over (partition by config order by x) + (count(*) over (partition by config, x) - 1) / 2 a, rank() over (partition by config order by y) + (count(*) over (partition by config, y) - 1) / 2 b from p)
        select config, count(*) n, round(corr(a, b), 5) spearman from r group by 1"""),
    "y02_performance": f"""with {FACT_SQL}, {IDS_SQL}, {PERF_SQL} select player_id, year, round(ln(1 + b), 6) log_bat_balls, round(case when b >= 6 then 100 * r / b end, 6) bat_strike_rate, round(ln(1 + b2), 6) log_bowl_balls,
        round(case when b2 >= 6 then 6 * r2 / b2 end, 6) bowl_economy, round(case when b2 >= 6 then 24 * w2 / b2 end, 6) bowl_wickets_24, round(ln(1 + h), 6) log_main_balls, b + b2 > 0 has_prior from g""",
    "pred21_levels": f"with {SALES_SQL} select role as level, count(*) n_rows from sa where role <> (select min(role) from sa) group by 1",
    "y05_year_line": f"with {SALES_SQL} select role, count(*) n, round(regr_slope(price, year - 2020), 2) slope, round(regr_intercept(price, year - 2020), 2) as intercept from ru group by 1",
}
