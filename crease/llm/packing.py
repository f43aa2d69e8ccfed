"""Documents of varying length packed into packs of fixed capacity, with little room unused.

The scheme is linear grouping: large lengths are sorted and cut into groups of equal cardinality, each rounded up to
the largest of its group, so that few sizes remain; a configuration is a multiset of sizes that fits a pack. The few
sizes are packed by configurations chosen one after another for the least unused room, the documents of a group take
the places of its size, and small documents are then put by best fit into the room that is really left. Only sizes
travel, never texts. The corpus is spread by a hash of the document over shards of bounded size, each packed by
itself; with thousands of documents in a shard, what sharding wastes is below one pack for each shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.tokens import with_tokens
from crease.sources.tables import bounded_rows, durable, table

#: Documents in a shard at most (on average); items over this share of the capacity are large; groups of large items at
#: most, which is more than there are lengths where the capacity is small, so that rounding costs little there.
SHARD_ROWS, LARGE, GROUPS = 20_000, 0.10, 1000
#: Steps of the search for one configuration; capacities that are broadcast at most (more are joined otherwise).
STEPS, FEW_CAPACITIES = 400, 1000


def group_sizes(lengths: list[int], groups: int) -> list[list[int]]:
    """Positions of descending ``lengths`` cut into groups of equal cardinality."""
    n = len(lengths)
    step = max(1, -(-n // groups))
    return [list(range(i, min(n, i + step))) for i in range(0, n, step)]


def best_configuration(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """Size number -> count for one pack with the least unused room, within what is left of each size (descending).

    A bounded search: the largest size left opens the pack, then depth first over ever smaller sizes; the first
    filling without waste ends it, and a budget of steps bounds it.
    """
    first = next(i for i, k in enumerate(left) if k)
    below = [-x for x in sizes]
    best_room, best = capacity + 1, []
    budget = STEPS

    def fill(i: int, room: int, chosen: list[int]) -> bool:
        nonlocal best_room, best, budget
        budget -= 1
        if room < best_room:
            best_room, best = room, list(chosen)
        if room == 0 or budget <= 0:
            return True
        for j in range(bisect_left(below, -room, i), len(sizes)):
            if left[j] and left[j] > chosen.count(j):
                chosen.append(j)
                done = fill(j, room - sizes[j], chosen)
                chosen.pop()
                if done:
                    return True
        return False

    fill(first, capacity - sizes[first], [first])
    return Counter(best)


def pack_lengths(lengths: list[int], capacity: int, large: float = LARGE, groups: int = GROUPS) -> list[int]:
    """A pack number for each length; every pack's lengths sum to at most the capacity (each length must fit).

    Lengths of 0 are put with the rest. Ties are kept in the given order, so equal input gives equal packs.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    big = [i for i in order if lengths[i] > large * capacity]
    small = [i for i in order if lengths[i] <= large * capacity]
    pack_of = [0] * len(lengths)
    room: list[int] = []
    cut = group_sizes([lengths[i] for i in big], groups)
    sizes = [lengths[big[g[0]]] for g in cut]
    queues = [[big[p] for p in reversed(g)] for g in cut]  # the last is the largest of its group
    left = [len(q) for q in queues]
    while left:
        counts = best_configuration(sizes, left, capacity)
        times = min(left[j] // k for j, k in counts.items())
        for _ in range(times):
            used = 0
            for j, k in counts.items():
                for _ in range(k):
                    i = queues[j].pop()
                    pack_of[i] = len(room)
                    used += lengths[i]
            room.append(capacity - used)
        # Sizes that are used up leave the search.
        some = [j for j, q in enumerate(queues) if q]
        if len(some) < len(queues):
            sizes, queues = [sizes[j] for j in some], [queues[j] for j in some]
        left = [len(q) for q in queues]
    free = sorted((r, b) for b, r in enumerate(room))
    for i in small:
        at = bisect_left(free, (lengths[i], -1))
        if at == len(free):
            b, r = len(room), capacity
            room.append(capacity)
        else:
            r, b = free.pop(at)
        pack_of[i] = b
        insort(free, (r - lengths[i], b))
    return pack_of


def pack(items: DataFrame, capacities: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(pack_name, pack_id, doc_id, piece, from_token, n_tokens) of every document in packs of every capacity.

    items: distinct (doc_id, n_tokens); capacities: (pack_name, capacity_tokens), positive. A document longer than
    the capacity is split into pieces of the capacity and a last one; no other is split. Pieces of the full capacity are
    packs by themselves and are not shuffled; only the others, at most one for each document, go to the shards.
    Documents of 0 tokens and NULL ids are left out. pack_id is unique within a pack_name. Empty tables give an empty
    result.
    """
    items = items.where("n_tokens > 0 and doc_id is not null")
    few = bounded_rows(capacities.where("capacity_tokens > 0"), FEW_CAPACITIES)
    sizes = capacities.where("capacity_tokens > 0")
    rows = items.crossJoin(F.broadcast(sizes) if few is not None else sizes)
    whole = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("bigint")
    rest = F.col("n_tokens") - whole * F.col("capacity_tokens")
    full = rows.where(whole > 0).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)))
    full = full.select("pack_name", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("pack_id"), "doc_id", "piece", (F.col("piece") * F.col("capacity_tokens")).alias("from_token"), F.col("capacity_tokens").alias("n_tokens"))
    last = rows.where(rest > 0).select("pack_name", "capacity_tokens", "doc_id", whole.alias("piece"), (whole * F.col("capacity_tokens")).alias("from_token"), rest.alias("n_tokens"))
    shards = max(1, -(-items.count() // shard_rows))
    last = last.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        packs = pack_lengths(pdf["n_tokens"].tolist(), int(pdf["capacity_tokens"].iloc[0]))
        pdf = pdf.assign(pack_id=[f"{key[1]}-{p}" for p in packs])
        return pdf[["pack_name", "pack_id", "doc_id", "piece", "from_token", "n_tokens"]]

    schema = "pack_name string, pack_id string, doc_id bigint, piece bigint, from_token bigint, n_tokens bigint"
    return last.groupBy("pack_name", "shard").applyInPandas(fill, schema).unionByName(full)


def measured(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, source, n_tokens) of each distinct document."""
    docs = table(spark, base, "documents").select("doc_id", "source", "text").distinct()
    return durable(with_tokens(docs).select("doc_id", "source", "n_tokens").dropDuplicates(["doc_id"]))


def p8_packs(spark: SparkSession, base: str) -> DataFrame:
    return pack(measured(spark, base).select("doc_id", "n_tokens"), table(spark, base, "pack_capacity").distinct())


def p8_usage(spark: SparkSession, base: str) -> DataFrame:
    """For each capacity: documents, packs, tokens and the share of the packs' room that is used."""
    packs = p8_packs(spark, base).groupBy("pack_name", "pack_id").agg(F.sum("n_tokens").alias("used"), F.count_distinct("doc_id").alias("docs"))
    by = packs.groupBy("pack_name").agg(F.count("*").alias("n_packs"), F.sum("used").alias("n_tokens"))
    return by.join(table(spark, base, "pack_capacity").distinct(), "pack_name").withColumn("used_share", F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")), 6))


QUERIES = {"p8_packs": p8_packs, "p8_usage": p8_usage}
