"""Prefix sums, ranks and medians of a table without putting a key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crease.sources.tables import durable


def prefix_sums(df: DataFrame, keys: list[str], order: Column, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``keys`` before this one.

    ``order`` is an unsigned 31-bit integer, best a hash that is unique or followed by ties of no matter; its
    range is cut in ``buckets`` equal parts (by default as many as hold about 100,000 rows each, at least 64). Every
    part is summed first (partial aggregation), the running totals of the parts come from a table of at most keys x
    buckets rows, and only the sort within a part is a window. So a key with a third of all rows spreads over many tasks.
    """
    if buckets is None:
        buckets = min(1 << 20, max(64, df.count() // 100_000))
    width = (1 << 31) // buckets + 1
    rows = df.withColumn("_o", order).withColumn("_b", F.floor(F.col("_o") / width).cast("int"))
    parts = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = rows.join(parts, [*keys, "_b"])
    return same.withColumn(out, F.col("_before") + F.col("_in")).drop("_o", "_b", "_before", "_in")


def value_counts_before(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows of that value), before (rows of the same keys with a smaller value); NULL values are left out.

    The distinct values are sorted by range over all tasks; each range is summed, and only the ranges' totals meet.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    # Range bounds are drawn from a sample, so the number of a row's range is written before it is read twice.
    ranged = durable(counts.repartitionByRange(*[F.col(k) for k in keys], F.col(value)).withColumn("_p", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_p").agg(F.sum("n").alias("_t"))
    # At most as many rows as ranges for each key.
    parts = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_p", F.coalesce(F.sum("_t").over(parts), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("_in", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), "_before")
    condition = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = inner.join(totals, condition)
    return joined.select(*keys, value, "n", (F.col("_before") + F.col("_in")).alias("before"))


def rank_percentiles(df: DataFrame, keys: list[str], value: str, out: str, highest_first: bool = False) -> DataFrame:
    """df + ``out``: the average-rank percentile of a value among the non-NULL values of the same keys; NULL for NULL."""
    at = value_counts_before(df, keys, value)
    size = at.groupBy(*keys).agg(F.sum("n").alias("_size"))
    at = at.join(size, keys) if keys else at.crossJoin(size)
    rank = F.col("before") + (F.col("n") + 1) / 2
    share = (F.col("_size") + 1 - rank) / F.col("_size") if highest_first else rank / F.col("_size")
    return df.join(at.select(*keys, value, share.alias(out)), [*keys, value], "left")


def medians(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, ``out``: the exact median of the non-NULL values of each key (no row for a key without any)."""
    at = value_counts_before(df, keys, value)
    size = at.groupBy(*keys).agg(F.sum("n").alias("_size"))
    at = at.join(size, keys) if keys else at.crossJoin(size)
    low, high = F.floor((F.col("_size") - 1) / 2), F.floor(F.col("_size") / 2)
    holds = lambda k: F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value))
    return at.groupBy(*keys).agg(((F.max(holds(low)) + F.max(holds(high))) / 2).alias(out))


def dense_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df + ``out``: the number of distinct values up to this one, over the whole table (NULL for NULL)."""
    distinct = df.select(value).distinct()
    at = value_counts_before(distinct, [], value)
    return df.join(at.select(value, (F.col("before") + 1).alias(out)), value, "left")
