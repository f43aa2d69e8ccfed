"""Sources mixed to target shares of the total size, interleaved with less than one block of deviation.

The largest total that every source can supply within its cap of repetitions fixes how many tokens each source gives.
Its documents are taken in hash order, all of them as often as needed and a rest once more, and cut into blocks of
whole documents. The order of blocks is a Pfair schedule in which a block carries its real length: a block that holds
the tokens from p to q of a source of weight w is released when the mix is p / w long and due when it is q / w long,
and among those released the one due first is placed. With blocks of one size these are the windows floor((k-1)/w) and
ceil(k/w). Whoever reads the mix up to the end of any block finds each source within one block of its share, a block
being ``block_tokens``: what it is cut at, and the longest document. The schedule depends on the lengths of a bounded
number of blocks alone, so one task makes it as they come by release, holding those that are not yet placed; documents
only join it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crease.functions.prefix import prefix_sums
from crease.llm.packing import measured
from crease.llm.tokens import hash31
from crease.sources.tables import durable, table

#: Blocks in the whole mix at most, but for one more of each source; the block grows with the corpus.
BLOCKS, MIN_BLOCK = 100_000, 4_096
#: Rows of the schedule that are handed on at once.
ROWS = 10_000


def in_order(blocks: Iterable[tuple]) -> Iterator[tuple]:
    """The blocks (release, deadline, source, block number, length, ...), given by release, as an earliest-deadline-first schedule.

    A block may be placed when the mix has reached its release; among those released the earliest deadline goes first,
    then the name. Where no block is released, the mix waits for the next release (the shares did not add up to it).
    Only blocks that are released and not yet placed are held. Those of a source keep their order, as each is due
    after the one before it.
    """
    blocks = iter(blocks)
    coming = next(blocks, None)
    ready: list[tuple] = []
    now = 0.0
    while coming is not None or ready:
        while coming is not None and coming[0] <= now + 1e-6:
            heapq.heappush(ready, coming[1:] + coming[:1])
            coming = next(blocks, None)
        if not ready:
            now = coming[0]
            continue
        first = heapq.heappop(ready)
        yield first[-1:] + first[:-1]
        now += first[3]


def pfair(blocks: dict[str, list[float]], weights: dict[str, float]) -> list[tuple[str, int]]:
    """(source, block number from 1) in the order of the schedule of blocks of given lengths."""
    rows = []
    for s, lengths in blocks.items():
        start = 0.0
        for k, n in enumerate(lengths if weights[s] > 0 else [], 1):
            rows.append((start / weights[s], (start + n) / weights[s], s, k, n))
            start += n
    return [(x[2], x[3]) for x in in_order(sorted(rows))]


def placed_documents(items: DataFrame, supply: DataFrame, targets: DataFrame, blocks: int) -> DataFrame:
    """(source, w, block, block_tokens, doc_id, repeat, n_tokens) of every use of a document in the mix."""
    plan = supply.join(targets, "source").where("target_share > 0 and max_repeats > 0")
    share = plan.agg(F.sum("target_share").alias("share"))
    plan = plan.crossJoin(F.broadcast(share)).withColumn("w", F.col("target_share") / F.col("share"))
    whole = plan.agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("w")).alias("total"), F.max("longest").alias("longest_of_all"))
    plan = plan.crossJoin(F.broadcast(whole)).withColumn("wanted", F.col("w") * F.col("total"))
    plan = plan.withColumn("cut", F.greatest(F.lit(float(MIN_BLOCK)), F.col("total") / blocks))
    plan = plan.select("source", "w", "wanted", "tokens", "max_repeats", "cut", (F.col("cut") + F.col("longest_of_all")).alias("block_tokens"))
    # Whole rounds first, then those documents once more whose tokens before them leave room.
    rounds = F.least(F.col("max_repeats") - 1, F.floor(F.col("wanted") / F.col("tokens")))
    docs = items.join(plan, "source").withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds)))
    placed = prefix_sums(docs, ["source", "round"], hash31("doc_id", "round"), "n_tokens", "before")
    at = F.col("round") * F.col("tokens") + F.col("before")
    placed = placed.withColumn("at", at).where(F.col("at") + F.col("n_tokens") / 2 <= F.col("wanted"))
    return placed.select("source", "w", (F.floor(F.col("at") / F.col("cut")) + 1).cast("bigint").alias("cut_no"), "block_tokens", "doc_id", F.col("round").alias("repeat"), "n_tokens")


def mix(items: DataFrame, targets: DataFrame, blocks: int = BLOCKS, sources: int | None = None) -> DataFrame:
    """(slot, source, block, doc_id, repeat, n_tokens, block_tokens): the mix in order of slot, then within its block.

    items: distinct (doc_id, source, n_tokens); targets: (source, target_share, max_repeats). Sources without a
    target, with a share of 0 or without any token take no part (their share is missing for the others to fill in
    proportion); documents of 0 tokens are left out. A document is used at most max_repeats times. Any number of
    sources is scheduled alike; ``sources``, once the number from which it was not, has no effect.
    """
    items = durable(items.where("n_tokens > 0 and source is not null and doc_id is not null"))
    supply = items.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest"))
    placed = durable(placed_documents(items, supply, targets, blocks))
    # Cuts in which no document starts make no block: blocks are numbered without gaps, with their real lengths.
    cuts = placed.groupBy("source", "cut_no").agg(F.sum("n_tokens").alias("n"), F.first("w").alias("w"))
    own = Window.partitionBy("source").orderBy("cut_no")  # at most one row for each block of the mix
    start = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = cuts.withColumns({"block": F.row_number().over(own).cast("bigint"), "start": start})
    timed = durable(timed.select((F.col("start") / F.col("w")).alias("release"), ((F.col("start") + F.col("n")) / F.col("w")).alias("due"), "source", "block", F.col("n").cast("double").alias("n"), "cut_no"))

    def schedule(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = in_order(r for b in batches for r in b.itertuples(index=False, name=None))
        slot = 0
        while some := list(islice(rows, ROWS)):
            yield pd.DataFrame({"source": [r[2] for r in some], "cut_no": [r[5] for r in some], "block": [r[3] for r in some], "slot": range(slot, slot + len(some))})
            slot += len(some)

    # One task, as each slot depends on those before it: at most ``blocks`` and two more of each source pass through it.
    by_release = timed.coalesce(1).sortWithinPartitions("release", "due", "source", "block")
    order = by_release.mapInPandas(schedule, "source string, cut_no bigint, block bigint, slot bigint")
    out = placed.join(order, ["source", "cut_no"])
    return out.select("slot", "source", "block", "doc_id", "repeat", "n_tokens", "block_tokens")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source of the targets: its tokens in the mix, the share reached and the share wanted."""
    by = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_uses"), F.max("repeat").alias("most"))
    total = by.agg(F.sum("n_tokens").alias("total"))
    out = targets.join(by, "source", "left").crossJoin(F.broadcast(total))
    tokens = F.coalesce("n_tokens", F.lit(0))
    return out.select("source", tokens.alias("n_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), (F.coalesce("most", F.lit(-1)) + 1).alias("most_uses"), F.round(tokens / F.col("total"), 6).alias("share"), "target_share")


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return mix(measured(spark, base), table(spark, base, "mix_targets").distinct())


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    return reached(p9_mix(spark, base), table(spark, base, "mix_targets").distinct())


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
