"""Where intermediate results go that several jobs read."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def set_checkpoints(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir. Where it is unset, as in tests, a local session gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='spark-')}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tidying, _lock = [], threading.Lock()


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Meanwhile a query's shuffle files go when its result is there, and not when the driver happens to collect its garbage.

    Results that were kept read none of them again; a table that is worked out twice shuffles twice."""
    with _lock:
        _tidying.append(spark.conf.get(_CLEANUP, "false"))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            before = _tidying.pop()
            if not _tidying:
                spark.conf.set(_CLEANUP, before)


def stored(frame: DataFrame, paths: list[str]) -> DataFrame:
    """The frame as a table in the folder of checkpoints; its path is added to `paths`, for removed()."""
    set_checkpoints(frame.sparkSession)
    path = f"{frame.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    paths.append(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of stored() that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    paths.clear()


def at_once(spark: SparkSession, parts: Sequence[Callable[[], DataFrame]], most: int = 4) -> list[DataFrame]:
    """The parts' tables, each worked out and kept, up to `most` at a time, so that one's short jobs fill what others leave idle.

    What a part shuffles goes as soon as it is done with, so that the parts' files don't add up."""
    set_checkpoints(spark)
    kept = inheritable_thread_target(spark)(lambda part: part().checkpoint())
    with tidied(spark), ThreadPoolExecutor(most) as pool:
        return list(pool.map(kept, parts))


#: Sides of joins with at most so many short rows are sent to every executor; longer ones are shuffled.
BROADCAST_ROWS = 250_000


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if a count finds at most so many rows in it."""
    return F.broadcast(table) if table.count() <= rows else table
