"""The canonical long table of curve points, its checks and its cleaning.

Columns: id_objeto, banda, t (days), m (magnitude), e (error, may be null), clase (may be null), src_idx (place in the
source, may be null). One row is one observation; points of a curve share id_objeto and banda.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ["id_objeto", "banda", "t", "m", "e", "clase", "src_idx"]
CURVE = ["id_objeto", "banda"]
BAND_PRIORITY = ("r", "g", "i")
#: Points of a task that works on whole curves, about.
TASK_POINTS = 200_000
#: Strings that stand for "no value" in text columns.
NULL_TOKENS = ("NaN", "null", "", "-999", "-99.9")


def canonical(frame: DataFrame) -> DataFrame:
    """The frame with all canonical columns and types; missing ones are null."""
    kinds = {"id_objeto": "string", "banda": "string", "t": "double", "m": "double", "e": "double", "clase": "string", "src_idx": "long"}
    return frame.select(*((F.col(c) if c in frame.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS))


def dealt(points: DataFrame, n: int, keys: Sequence[str] = ("id_objeto",)) -> DataFrame:
    """About n points dealt by their object over so many tasks that each has about TASK_POINTS of them.

    What follows by object or by curve works on these partitions. Left to the size of the shuffle, a task would have some
    64 MB of packed points, which its sorts and windows hold several times over as rows.
    """
    tasks = max(math.ceil(n / TASK_POINTS), min(points.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 1000)), 1)
    return points.repartition(tasks, *keys)


def finite(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def days(ts: Column) -> Column:
    """Modified Julian days of a timestamp."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0) + F.lit(40_587.0)


def coerced(column: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """A text column as numbers: null tokens and what can't be read become null."""
    return F.when(~column.isin(*tokens), column.try_cast("double"))


def clean(points: DataFrame) -> DataFrame:
    """Points finite in t, m and, where there is an error, e."""
    return points.where(finite("t") & finite("m") & (F.col("e").isNull() | finite("e")))


def validity(points: DataFrame) -> DataFrame:
    """(id_objeto, banda, n_points, n_finite, valid): a curve is valid with two or more points finite in t and m."""
    return points.groupBy(*CURVE).agg(F.count("*").alias("n_points"), F.count_if(finite("t") & finite("m")).alias("n_finite")).withColumn("valid", F.col("n_finite") >= 2)


def valid_curves(points: DataFrame) -> DataFrame:
    n = F.count_if(finite("t") & finite("m")).over(Window.partitionBy(*CURVE))
    return points.withColumn("__n", n).where("__n >= 2").drop("__n")


def main_band(points: DataFrame, priority: Sequence[str] = BAND_PRIORITY) -> DataFrame:
    """Each object's points in its main band: the first of `priority` that it has, else its first band.

    "First" is by src_idx where the source gives one, else by name. Points without a band only count if there is no other.
    """
    rank = F.lit(len(priority))
    for i, band in reversed(list(enumerate(priority))):
        rank = F.when(F.col("banda") == band, i).otherwise(rank)
    bands = points.groupBy(*CURVE).agg(F.min("src_idx").alias("first"))
    order = Window.partitionBy("id_objeto").orderBy(F.col("banda").isNull(), rank, F.col("first").asc_nulls_last(), "banda")
    chosen = bands.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(F.col("id_objeto").alias("__id"), F.col("banda").alias("__b"))
    return points.join(chosen, (F.col("id_objeto") == F.col("__id")) & F.col("banda").eqNullSafe(F.col("__b"))).drop("__id", "__b")


def first_named_band(points: DataFrame, bands: Sequence[str] = BAND_PRIORITY) -> DataFrame:
    """Each object's points in the first of these bands that it has, however few they are; objects with none are left out."""
    return main_band(points.where(F.col("banda").isin(*bands)), bands)


def last_duplicate(points: DataFrame, copy: str) -> DataFrame:
    """Each curve's points of its last copy only, where a source gives a curve several times: those with the largest `copy`."""
    last = points.groupBy(*CURVE).agg(F.max(copy).alias("__last")).withColumnsRenamed({c: f"__{c}" for c in CURVE})
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CURVE]
    return points.join(last, [*same, F.col(copy).eqNullSafe(F.col("__last"))]).drop("__last", *(f"__{c}" for c in CURVE))


def longest_band(points: DataFrame, priority: Sequence[str] = ("g", "r", "i")) -> DataFrame:
    """(id_objeto, banda, n): the band with most points; ties go by priority and then name."""
    rank = F.lit(len(priority))
    for i, band in reversed(list(enumerate(priority))):
        rank = F.when(F.col("banda") == band, i).otherwise(rank)
    counts = points.groupBy(*CURVE).agg(F.count("*").alias("n"))
    order = Window.partitionBy("id_objeto").orderBy(F.desc("n"), rank, "banda")
    return counts.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
