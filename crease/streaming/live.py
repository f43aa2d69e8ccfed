"""Event and delivery feeds as streams; the same functions run on a table, where the watermark has no effect."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from crease.sources.tables import table

LATE = "10 minutes"


def deduplicated(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, whatever time its repetition comes at, within the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling (or sliding) windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = deduplicated(events).groupBy(w, "event_type").agg(F.count("*").alias("n_events"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n_events", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events at most ``gap`` apart."""
    g = deduplicated(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n_events")


class InningsState(StatefulProcessor):
    """Runs, wickets and legal balls of an innings, kept by the engine's state store; a delivery counts once.

    Keys of deliveries seen are kept with the innings, as many as an innings has balls, so a delivery that comes again
    in a later batch changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "runs bigint, wickets bigint, balls bigint")
        self.seen = handle.getMapState("seen", "delivery_key string", "there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs, wickets, balls = self.totals.get() if self.totals.exists() else (0, 0, 0)
        for b in rows:
            for r in b.itertuples():
                if r.delivery_key is None or self.seen.containsKey((r.delivery_key,)):
                    continue
                self.seen.updateValue((r.delivery_key,), (True,))
                known = lambda x: 0 if pd.isna(x) else int(x)
                runs, wickets, balls = runs + known(r.total_runs), wickets + known(r.is_wicket), balls + known(r.is_legal)
        self.totals.update((runs, wickets, balls))
        yield pd.DataFrame({"match_id": [key[0]], "innings_number": [key[1]], "runs": [runs], "wickets": [wickets], "balls": [balls]})

    def close(self) -> None:
        pass


def live_innings(deliveries: DataFrame) -> DataFrame:
    """Running state of each innings from a delivery stream (delivery_key, match_id, innings_number, total_runs, is_wicket,
    is_legal). Needs a state store that holds several states (RocksDB); it is recovered from the checkpoint."""
    return deliveries.groupBy("match_id", "innings_number").transformWithStateInPandas(
        statefulProcessor=InningsState(), outputStructType="match_id string, innings_number bigint, runs bigint, wickets bigint, balls bigint", outputMode="Update", timeMode="None",
    )


def written_once(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A sink that a repeated batch does not write twice: each batch replaces its own folder, named by its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def st_windows(spark: SparkSession, base: str) -> DataFrame:
    w = windowed(table(spark, base, "events"))
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def st_sessions(spark: SparkSession, base: str) -> DataFrame:
    return sessions(table(spark, base, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def st_sliding(spark: SparkSession, base: str) -> DataFrame:
    return windowed(table(spark, base, "events"), "2 hours", "1 hour").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {"st_windows": st_windows, "st_sessions": st_sessions, "st_sliding": st_sliding}
SQL = {
    "st_sliding": """with e as (select distinct * from events), w as (select *, unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) s from e)
        select strftime(s, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n_events, round(sum(value), 4) total from w group by 1, 2""",
    "st_windows": "with e as (select distinct * from events) select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) n_events, round(sum(value), 4) total from e group by 1, 2",
    "st_sessions": """with e as (select distinct * from events), f as (select *, case when ts - lag(ts) over w <= interval '30 minutes' then 0 else 1 end fresh from e window w as (partition by user_id order by ts)),
        s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) k from f) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) n_events from s group by user_id, k""",
}
