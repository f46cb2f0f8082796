"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of joins with at most so many short rows are sent to every executor; longer ones are shuffled.
BROADCAST_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, as in tests, a local session gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(frame: DataFrame, used: list[str] | None = None) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, so lost executors cost no recomputation.

    The table's path is added to `used`, for dropped()."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(spark: SparkSession, used: list[str]) -> None:
    """Deletes tables that nothing will read again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in used:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    used.clear()


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if a count finds at most so many rows in it; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= rows else table


def clear_of(frame: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The frame with its columns of these names renamed: `input_` goes before them, as often as is needed."""
    renamed = {}
    for name in names:
        if name in frame.columns:
            new = f"input_{name}"
            while new in frame.columns or new in renamed.values():
                new = f"input_{new}"
            renamed[name] = new
    return frame.withColumnsRenamed(renamed)


def free_names(frame: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The names, each with as many `_` before it as it takes to be no column of the frame, whatever the case."""
    taken, free = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        free.append(name)
    return free
