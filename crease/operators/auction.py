"""Auction records of four yearly layouts in one table, resale, baselines and point-in-time features of prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.prefix import medians
from crease.functions.scalars import blank_to_null, money, name_key, role_name
from crease.sources.tables import table

TRAIN_TO, VALID_TO = 2022, 2024


def sales(spark: SparkSession, base: str) -> DataFrame:
    """One row for each lot: the price column by layout (winning bid, then rupees, then dollars) and its currency."""
    lots = table(spark, base, "auction_lots").drop("loaded_at").dropDuplicates(["lot_id"])
    price = F.coalesce(money(F.col("winning_bid_in_rs")), money(F.col("price_in_rs")), money(F.col("price_in_usd")))
    currency = F.when(money(F.col("winning_bid_in_rs")).isNotNull() | money(F.col("price_in_rs")).isNotNull(), "INR").when(money(F.col("price_in_usd")).isNotNull(), "USD")
    return lots.select(
        "lot_id", F.col("auction_year").alias("year"), blank_to_null(F.col("name_raw")).alias("player_name"), name_key(F.col("name_raw")).alias("player"), blank_to_null(F.col("team_name")).alias("team"),
        role_name(F.col("role_raw")).alias("role"), blank_to_null(F.col("nationality")).alias("nationality"), price.alias("price"), currency.alias("currency"), money(F.col("base_prices_in_rs")).alias("base_price"), "source_file",
    )


def rupees(spark: SparkSession, base: str) -> DataFrame:
    return sales(spark, base).where("currency = 'INR' and price >= 1000000")


def role_prices(spark: SparkSession, base: str) -> DataFrame:
    return rupees(spark, base).groupBy("year", "role").agg(F.count("*").alias("n_sold"), F.round(F.avg("price"), 2).alias("mean_price"), F.round(F.median("price"), 2).alias("median_price"), F.max("price").alias("max_price"))


def resale(spark: SparkSession, base: str) -> DataFrame:
    """Ratio of a player's price to the sale before, one sale a year (the dearest, ties by lot), with the gap in years."""
    one = Window.partitionBy("player", "year").orderBy(F.desc("price"), "lot_id")
    yearly = rupees(spark, base).where("player <> ''").withColumn("k", F.row_number().over(one)).where("k = 1").drop("k")
    w = Window.partitionBy("player").orderBy("year")
    j = yearly.withColumns({"prev_price": F.lag("price").over(w), "prev_year": F.lag("year").over(w)}).where("prev_price is not null")
    return j.select("player", "year", "price", "prev_price", (F.col("year") - F.col("prev_year")).alias("gap"), F.round(F.col("price") / F.col("prev_price"), 6).alias("ratio"))


def yearly_medians(rows: DataFrame) -> DataFrame:
    return medians(rows, ["year"], "price", "year_median")


def spend_by_origin(spark: SparkSession, base: str) -> DataFrame:
    """Each year's rupee spend on overseas and Indian players, their number, and the ratio of the mean prices."""
    origin = F.lower(F.trim(F.coalesce("nationality", F.lit(""))))
    kind = F.when(origin.rlike("^ind"), "indian").when(origin != "", "overseas")
    rows = rupees(spark, base).withColumn("kind", kind)
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, c)), F.lit(0))
    g = rows.groupBy("year").agg(of("overseas", F.col("price")).alias("o"), of("indian", F.col("price")).alias("i"), F.count_if(F.col("kind") == "overseas").alias("n_overseas"), F.count_if(F.col("kind") == "indian").alias("n_indian"))
    mean = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n))
    return g.select("year", "n_overseas", "n_indian", F.round("o", 2).alias("overseas_spend"), F.round("i", 2).alias("indian_spend"), F.round(mean("o", "n_overseas") / mean("i", "n_indian"), 6).alias("mean_ratio"))


def baselines(spark: SparkSession, base: str) -> DataFrame:
    """Four naive predictors fitted on years up to TRAIN_TO, scored on the validation years.

    The scalars and the per-role and per-year medians are small aggregates that join every scored row.
    """
    rows = rupees(spark, base)
    train, valid = rows.where(F.col("year") <= TRAIN_TO), rows.where((F.col("year") > TRAIN_TO) & (F.col("year") <= VALID_TO))
    glob = train.agg(F.avg("price").alias("global_mean")).join(medians(train, [], "price", "global_median"))
    by_role = medians(train, ["role"], "price", "role_median")
    before = yearly_medians(rows).select((F.col("year") + 1).alias("year"), F.col("year_median").alias("prev_year_median"))
    j = valid.crossJoin(F.broadcast(glob)).join(by_role, "role", "left").join(before, "year", "left")
    j = j.withColumns({"role_median": F.coalesce("role_median", "global_median"), "prev_year_median": F.coalesce("prev_year_median", "global_median")})
    m = j.unpivot(["lot_id", "price"], ["global_mean", "global_median", "role_median", "prev_year_median"], "baseline", "p")
    e, le = F.col("p") - F.col("price"), F.log1p("p") - F.log1p("price")
    return m.groupBy("baseline").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 2).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"), F.round(F.avg(F.abs(le)), 6).alias("log_mae"))


def price_features(spark: SparkSession, base: str) -> DataFrame:
    """Features known before each sale: the player's last price and gap, the market's median of the year before."""
    one = Window.partitionBy("player", "year").orderBy(F.desc("price"), "lot_id")
    yearly = rupees(spark, base).where("player <> ''").withColumn("k", F.row_number().over(one)).where("k = 1").drop("k")
    w = Window.partitionBy("player").orderBy("year")
    before = yearly_medians(rupees(spark, base)).select((F.col("year") + 1).alias("year"), F.log1p("year_median").alias("market"))
    j = yearly.withColumns({"prev": F.lag("price").over(w), "gap": F.col("year") - F.lag("year").over(w)}).join(before, "year", "left")
    return j.select("player", "year", F.log1p("price").alias("y"), F.log1p("prev").alias("prev_log_price"), F.col("gap").cast("double").alias("gap"), F.col("prev").isNotNull().cast("double").alias("has_prev"), "market")


def price_features_query(spark: SparkSession, base: str) -> DataFrame:
    f = price_features(spark, base)
    return f.select("player", "year", *[F.round(c, 8).alias(c) for c in ("y", "prev_log_price", "gap", "has_prev", "market")])


QUERIES = {"s08_sales": sales, "f33_role_prices": role_prices, "w06_resale": resale, "f33_spend": spend_by_origin, "y01_baselines": baselines, "y02_price_features": price_features_query}

M = "try_cast(nullif(regexp_replace({0}, '[^0-9.]', '', 'g'), '') as double)".format
SALES_SQL = f"""lo as (select distinct * exclude (loaded_at) from auction_lots),
 sa as (select lot_id, auction_year as year, nullif(trim(name_raw, ' '), '') player_name, trim(regexp_replace(regexp_replace(lower(trim(name_raw)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) player, nullif(trim(team_name, ' '), '') team,
   case when lower(trim(role_raw)) in ('batsman', 'batter', 'bat') then 'Batter' when lower(trim(role_raw)) in ('bowler', 'bowl') then 'Bowler' when lower(trim(role_raw)) in ('all rounder', 'all-rounder', 'allrounder', 'ar') then 'All-Rounder'
        when lower(trim(role_raw)) in ('wicket keeper', 'wicket-keeper', 'wicketkeeper', 'wk') then 'Wicket-Keeper' else 'Unknown' end as role, nullif(trim(nationality, ' '), '') nationality,
   coalesce({M("winning_bid_in_rs")}, {M("price_in_rs")}, {M("price_in_usd")}) price, case when {M("winning_bid_in_rs")} is not null or {M("price_in_rs")} is not null then 'INR' when {M("price_in_usd")} is not null then 'USD' end currency,
   {M("base_prices_in_rs")} base_price, source_file from lo),
 ru as (select * from sa where currency = 'INR' and price >= 1000000),
 ye as (select * from (select *, row_number() over (partition by player, year order by price desc, lot_id) k from ru where player <> '') where k = 1),
 ym as (select year, median(price) year_median from ru group by 1)"""
SQL = {
    "f33_spend": f"""with {SALES_SQL}, k as (select year, price, case when lower(trim(nationality)) like 'ind%' then 'indian' when trim(nationality) <> '' then 'overseas' end kind from ru),
        g as (select year, coalesce(sum(price) filter (kind = 'overseas'), 0) o, coalesce(sum(price) filter (kind = 'indian'), 0) i, count(*) filter (kind = 'overseas') n_overseas, count(*) filter (kind = 'indian') n_indian from k group by 1)
        select year, n_overseas, n_indian, round(o, 2) overseas_spend, round(i, 2) indian_spend, round((o / nullif(n_overseas, 0)) / (i / nullif(n_indian, 0)), 6) mean_ratio from g""",
    "s08_sales": f"with {SALES_SQL} select * from sa",
    "f33_role_prices": f"with {SALES_SQL} select year, role, count(*) n_sold, round(avg(price), 2) mean_price, round(median(price), 2) median_price, max(price) max_price from ru group by 1, 2",
    "w06_resale": f"with {SALES_SQL}, l as (select player, year, price, lag(price) over w prev_price, year - lag(year) over w gap from ye window w as (partition by player order by year)) select player, year, price, prev_price, gap, round(price / prev_price, 6) ratio from l where prev_price is not null",
    "y01_baselines": f"""with {SALES_SQL}, g as (select avg(price) a, median(price) m from ru where year <= {TRAIN_TO}), ro as (select role, median(price) m from ru where year <= {TRAIN_TO} group by 1),
        j as (select price, g.a, g.m, coalesce(ro.m, g.m) r, coalesce(ym.year_median, g.m) y from ru cross join g left join ro using (role) left join ym on ym.year = ru.year - 1 where ru.year > {TRAIN_TO} and ru.year <= {VALID_TO}),
        u as (select 'global_mean' baseline, price, a p from j union all select 'global_median', price, m from j union all select 'role_median', price, r from j union all select 'prev_year_median', price, y from j)
        select baseline, count(*) n, round(avg(abs(p - price)), 2) mae, round(sqrt(avg(power(p - price, 2))), 2) rmse, round(avg(abs(ln(1 + p) - ln(1 + price))), 6) log_mae from u group by 1""",
    "y02_price_features": f"""with {SALES_SQL}, l as (select player, year, price, lag(price) over w prev, year - lag(year) over w gap from ye window w as (partition by player order by year))
        select player, l.year, round(ln(1 + price), 8) y, round(ln(1 + prev), 8) prev_log_price, round(gap::double, 8) gap, case when prev is null then 0.0::double else 1.0::double end has_prev, round(ln(1 + year_median), 8) market from l left join ym on ym.year = l.year - 1""",
}
