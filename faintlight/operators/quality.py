"""Order, ties, padding, duplicates and leakage in tables of curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.curves import CURVE


def time_order(points: DataFrame, keys: list[str] = CURVE, order: str = "src_idx") -> DataFrame:
    """Steps back in time and equal times, in the order of storage."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy(order))
    p = points.withColumn("__d", step)
    return p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("__d") < 0).alias("inversions"), F.count_if(F.col("__d") == 0).alias("ties"),
    ).withColumn("inversion_fraction", F.coalesce(F.try_divide(F.col("inversions"), F.col("n") - 1), F.lit(0.0))).withColumn("is_sorted", F.col("inversions") == 0)


def tie_groups(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """Runs of two or more points at one time: t, size, whether their magnitudes agree, whether they end the curve."""
    last = F.max("t").over(Window.partitionBy(*keys))
    groups = points.withColumn("__last", last).groupBy(*keys, "t").agg(
        F.count("*").alias("size"), (F.min("m") == F.max("m")).alias("constant"), (F.max("__last") == F.col("t")).alias("at_end")
    )
    return groups.where("size >= 2")


def tail_padding(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """Padding at the end: points after the first of the last time, if their magnitudes agree."""
    last = F.max("t").over(Window.partitionBy(*keys))
    tail = points.withColumn("__last", last)
    at_end = F.col("t") == F.col("__last")
    same = F.min(F.when(at_end, F.col("m"))) == F.max(F.when(at_end, F.col("m")))
    return tail.groupBy(*keys).agg(F.count("*").alias("n"), F.when(same, F.count_if(at_end) - 1).otherwise(0).alias("n_padding")).withColumn("n_effective", F.col("n") - F.col("n_padding"))


def curve_hash(points: DataFrame, keys: list[str] = CURVE, decimals: int = 10) -> DataFrame:
    """(keys, content): a digest of each curve's rounded points in order of time, magnitude and error."""
    rounded = F.struct(*(F.round(F.col(c), decimals).alias(c) for c in ("t", "m", "e")))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    rows = F.transform(F.array_sort(F.collect_list(rounded)), lambda p: F.concat_ws("|", text(p["t"]), text(p["m"]), text(p["e"])))
    return points.groupBy(*keys).agg(F.sha1(F.concat_ws(";", rows)).alias("content"))


def exact_curve_hash(points: DataFrame, key: str = "id_objeto", bands: tuple[str, ...] = ("g", "r", "i")) -> DataFrame:
    """(key, content): a SHA-256 digest of all of an object's points in these bands, unrounded, band by band in order of time."""
    place = F.array_position(F.array(*map(F.lit, bands)), F.col("banda"))
    rows = F.array_sort(F.collect_list(F.when(place > 0, F.struct(place.alias("band"), "t", "m", "e"))))
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    parts = F.transform(rows, lambda p: F.concat_ws("|", p["band"].cast("string"), text(p["t"]), text(p["m"]), text(p["e"])))
    return points.groupBy(key).agg(F.sha2(F.concat_ws(";", parts), 256).alias("content"))


def without_known_curves(train: DataFrame, test: DataFrame, keys: list[str] = CURVE, decimals: int = 10) -> DataFrame:
    """The test curves (keys, content) whose content no train curve has, whatever its id and band."""
    return without_leaks(curve_hash(train, keys, decimals), curve_hash(test, keys, decimals), ["content"])


def without_leaks(train: DataFrame, test: DataFrame, on: list[str]) -> DataFrame:
    """Test rows none of whose columns `on` stands in train."""
    for c in on:
        test = test.join(train.select(c).distinct(), c, "left_anti")
    return test


def repeats(rows: DataFrame, column: str) -> DataFrame:
    """How many rows there are, how many different values, and how many rows repeat one."""
    return rows.agg(F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), (F.count(column) - F.count_distinct(column)).alias("n_repeated"))


def repeated_ids(rows: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Ids with several rows: how many, how many different contents, and whether they are all the same."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(F.struct(*content)).alias("n_contents")).where("n > 1")
    return found.withColumn("identical", F.col("n_contents") == 1)


def unique_with_first(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Each different key with the smallest index at which it stands, and how often it does."""
    return rows.groupBy(*keys).agg(F.min(index).alias("first"), F.count("*").alias("n"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many different keys two frames share, and whether that is none."""
    shared = a.select(key).distinct().join(b.select(key), key, "left_semi").agg(F.count("*").alias("n_shared"))
    return shared.withColumn("disjoint", F.col("n_shared") == 0)
