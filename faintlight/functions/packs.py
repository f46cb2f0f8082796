"""Feature packs over points with t, m and e, for curves, bands and all bands of an object together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.curves import clean

TINY = 1e-12


def _steps(points: DataFrame, keys: list[str]) -> DataFrame:
    time = Window.partitionBy(*keys).orderBy("t", "src_idx", "m", "e")
    p = clean(points).withColumn("__dm", F.col("m") - F.lag("m").over(time)).withColumn("__dt", F.col("t") - F.lag("t").over(time))
    return p.withColumn("__median", F.percentile("m", F.lit(0.5)).over(Window.partitionBy(*keys)))


def _q(column: str, *shares: float) -> list[Column]:
    q = F.percentile(column, F.array(*map(F.lit, shares)))
    return [q[i] for i in range(len(shares))]


def band_pack(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sixteen statistics of each curve with its errors and steps; the slope is null for fewer than three points."""
    p10, p90, p95, p5, p25, p75, median = _q("m", 0.10, 0.90, 0.95, 0.05, 0.25, 0.75, 0.5)
    return _steps(points, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), median.alias("median"),
        F.percentile(F.abs(F.col("m") - F.col("__median")), F.lit(0.5)).alias("mad"), F.min("m").alias("min"), F.max("m").alias("max"),
        (p95 - p5).alias("amplitude"), (p75 - p25).alias("iqr"), p10.alias("p10"), p90.alias("p90"),
        F.when(F.count("*") >= 3, F.regr_slope("m", "t")).alias("slope"), F.avg("e").alias("error_mean"), F.stddev_pop("e").alias("error_std"),
        F.avg("__dt").alias("cadence_mean"), F.stddev_pop("__dt").alias("cadence_std"),
    )


def strict_pack(points: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics with the time span, the share of the spread in the error, and the spread of the changes."""
    p5, p25, p75, p95 = _q("m", 0.05, 0.25, 0.75, 0.95)
    error = F.avg("e")
    return _steps(points, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), ((F.max("m") - F.min("m")) / 2).alias("amplitude"),
        p5.alias("q05"), p25.alias("q25"), p75.alias("q75"), p95.alias("q95"), (p75 - p25).alias("iqr"),
        (F.max("t") - F.min("t")).alias("time_span"), error.alias("mean_error"), F.when(error > TINY, F.stddev_pop("m") / error).alias("snr"),
        F.stddev_pop("__dm").alias("std_diff"),
    )


def concatenated_pack(points: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of all points of an object, its bands one after the other in order of name, with weighted mean,
    absolute changes and steps, and ratios that don't depend on the scale."""
    order = Window.partitionBy(*keys).orderBy("banda", "t", "src_idx", "m", "e")
    p = clean(points).withColumn("__dm", F.abs(F.col("m") - F.lag("m").over(order)))
    weight = 1 / F.greatest(F.abs(F.col("e")), F.lit(1e-6)) ** 2
    p25, median, p75 = _q("m", 0.25, 0.5, 0.75)
    spread = F.stddev_pop("m")
    return p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("m").alias("mean"), median.alias("median"), (F.sum(weight * F.col("m")) / F.sum(weight)).alias("weighted_mean"),
        spread.alias("std"), p25.alias("q25"), p75.alias("q75"), (F.max("m") - F.min("m")).alias("range"),
        F.avg("__dm").alias("change_mean"), F.max("__dm").alias("change_max"), F.stddev_pop("__dm").alias("change_std"),
        F.when(F.abs(median) > TINY, (F.max("m") - F.min("m")) / 2 / F.abs(median)).alias("percent_amplitude"),
        F.when(spread > TINY, F.avg("__dm") / spread).alias("change_ratio"), F.when(spread > TINY, (p75 - p25) / spread).alias("iqr_ratio"),
    )


def centred_pack(points: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of (m - median) / MAD; over the deviation where the MAD vanishes, and of m - median where both do."""
    curve = Window.partitionBy(*keys)
    p = clean(points).withColumn("__c", F.col("m") - F.percentile("m", F.lit(0.5)).over(curve))
    mad, std = F.percentile(F.abs(F.col("__c")), F.lit(0.5)).over(curve), F.stddev_pop("m").over(curve)
    p = p.withColumn("x", F.col("__c") / F.when(mad > TINY, mad).when(std > TINY, std).otherwise(1.0))
    p = p.withColumn("__mu", F.avg("x").over(curve))
    q10, q25, q50, q75, q90 = _q("x", 0.10, 0.25, 0.50, 0.75, 0.90)
    s = F.stddev_pop("x")
    return p.groupBy(*keys).agg(
        F.avg("x").alias("mean"), s.alias("std"), q10.alias("q10"), q25.alias("q25"), q50.alias("q50"), q75.alias("q75"), q90.alias("q90"),
        (F.max("x") - F.min("x")).alias("range"), F.when(s > TINY, F.avg((F.col("x") - F.col("__mu")) ** 3) / s**3).otherwise(0.0).alias("skew"),
    )


def weighted_pack(points: DataFrame, keys: list[str]) -> DataFrame:
    """Sample deviation, ranges in percent, error-weighted chi squared and Stetson's K, and von Neumann's eta."""
    curve = Window.partitionBy(*keys)
    weight = 1 / F.greatest(F.abs(F.col("e")), F.lit(1e-6)) ** 2
    p = _steps(points, keys).withColumn("__mu", F.avg("m").over(curve)).withColumn("__w", F.sum(weight * F.col("m")).over(curve) / F.sum(weight).over(curve))
    n = F.count("*")
    p = p.withColumn("__d", F.sqrt(F.count("*").over(curve) / F.nullif(F.count("*").over(curve) - 1, F.lit(0))) * (F.col("m") - F.col("__w")) / F.greatest(F.abs(F.col("e")), F.lit(1e-6)))
    p20, p25, p75, p80 = _q("m", 0.20, 0.25, 0.75, 0.80)
    square = F.sum((F.col("m") - F.col("__mu")) ** 2)
    slope = F.max(F.when(F.col("__dt") != 0, F.abs(F.col("__dm") / F.col("__dt"))))
    return p.groupBy(*keys).agg(
        n.alias("n"), F.stddev_samp("m").alias("std"), (p75 - p25).alias("ipr"), (p80 - p20).alias("p80_p20"),
        F.avg(((F.col("m") - F.col("__w")) / F.greatest(F.abs(F.col("e")), F.lit(1e-6))) ** 2).alias("chi2"),
        (F.avg(F.abs("__d")) / F.sqrt(F.avg(F.col("__d") ** 2))).alias("stetson_k"),
        F.when(square > TINY, F.sum(F.col("__dm") ** 2) / square).alias("eta"), F.coalesce(slope, F.lit(0.0)).alias("maximum_slope"),
    )


def ties_of_object(points: DataFrame, keys: list[str]) -> DataFrame:
    """How each curve repeats its times: groups of equal time (the last one left out if it ends the curve), how many of
    them have one value or several, and the smallest step above 0."""
    p = clean(points)
    last = F.max("t").over(Window.partitionBy(*keys))
    groups = p.withColumn("__last", last).groupBy(*keys, "t").agg(F.count("*").alias("c"), F.count_distinct("m").alias("d"), F.max("__last").alias("__last"))
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    tied = (F.col("c") > 1) & (F.col("t") < F.col("__last"))
    return groups.withColumn("step", step).groupBy(*keys).agg(
        F.count_if(tied).alias("groups"), F.count_if(tied & (F.col("d") == 1)).alias("constant"), F.count_if(tied & (F.col("d") > 1)).alias("differing"),
        F.sum(F.when(tied, F.col("c") - 1).otherwise(0)).alias("repeated"), F.min("step").alias("least_step"),
    )
