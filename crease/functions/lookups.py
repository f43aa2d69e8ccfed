"""Joins to lookup tables that guard what they promise: unique keys, no lost rows, every key found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.errors import LookupMissing


def guarded(dim: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of ``dim``; a key that occurs twice with other values raises when the row is read.

    So a left join to it keeps the number of rows. Repeated equal rows count once. NULL keys are left out.
    """
    rows = dim.distinct().where(" and ".join(f"`{k}` is not null" for k in keys))
    values = [c for c in dim.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in values])
    told = F.raise_error(F.concat(F.lit("the lookup has a key twice: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    checked = F.when(F.col("_n") > 1, told).otherwise(F.col("_n"))
    return one.withColumn("_n", checked).where("_n = 1").select(*dim.columns)


def with_lookup(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """df left joined to ``dim`` on ``keys`` (unique in ``dim``, or it raises); rows without a match have NULLs."""
    return df.join(guarded(dim, keys), keys, "left")


def with_required_lookup(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """As ``with_lookup``, but a row whose key is not found raises when it is read."""
    found = guarded(dim, keys).withColumn("_found", F.lit(True))
    told = F.raise_error(F.concat(F.lit("no lookup row for: "), F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])))
    # The check is part of the filter, so no projection can drop it.
    return df.join(found, keys, "left").where(F.coalesce(F.col("_found"), told.cast("boolean"))).drop("_found")


def require_all_found(df: DataFrame, dim: DataFrame, keys: list[str]) -> None:
    """Raises LookupMissing with the number of rows of ``df`` whose key ``dim`` lacks."""
    n = df.join(dim.select(*keys).distinct(), keys, "left_anti").count()
    if n:
        raise LookupMissing(f"{n} rows have no lookup row on {keys}")


def is_subset(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_missing, the distinct keys of ``left`` that ``right`` lacks, and whether there are none."""
    missing = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
    return missing.agg(F.count("*").alias("n_missing")).withColumn("is_subset", F.col("n_missing") == 0)


def ranked_best(value: Column, ranks: dict[str, int], other: int = 9) -> Column:
    """Aggregate: the value of the lowest rank in a group (ties by value); values that have no rank come last."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), value), F.lit(other))
    return F.min_by(value, F.struct(rank.alias("rank"), value.alias("value")))
