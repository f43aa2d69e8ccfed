"""Table access, the durable cut of lineage, and results shared by the queries of a session."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``; it is removed when the driver ends.

    On a cluster the setting is required, as executors do not see a folder of the driver's machine. Only in local mode,
    where driver and executor are one process, a temporary folder stands in for it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_folder, "local", None) or tempfile.mkdtemp(prefix="crease-")
        shared_folder.local = path
    folder = f"{path.rstrip('/')}/crease-{spark.sparkContext.applicationId}"
    made = vars(shared_folder).setdefault("made", {})
    if folder not in made:
        made[folder] = spark.sparkContext._jvm
        atexit.register(remove_folder, folder)
    return folder


def remove_folder(folder: str) -> None:
    """Deletes the written results of an application (when the driver ends, or earlier by whoever knows they are done)."""
    jvm = vars(shared_folder).get("made", {}).pop(folder, None)
    if jvm is None:
        return
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone; the folder then stays for the cluster's own cleaning
        pass


@contextmanager
def set_to(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The setting ``name`` has another value for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def in_place(spark: SparkSession):  # noqa: ANN201
    """While it lasts, sides laid out by some of a join's keys are joined where they lie."""
    return set_to(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Used where a result is read several times or a lineage grows with iterations. The files survive the loss of
    executors, unlike a cache or a local checkpoint. Shuffle files go as soon as the result is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with set_to(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(*made: DataFrame) -> None:
    """Deletes the files of durable results; whoever read them must be durable by now."""
    for df in made:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def once(spark: SparkSession, name: str, source: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` made durable once for an application and the files of ``source``; later calls read the same files."""
    key = (spark.sparkContext.applicationId, name, tuple(sorted(source.inputFiles())))
    made = vars(once).setdefault("made", {})
    if key not in made:
        made[key] = durable(build())
    return made[key]


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` if there are at most ``limit``, else None (the caller takes its other way)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
