"""Per-curve statistics with aggregates and windows; all of them share one shuffle by curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.curves import CURVE, clean, finite

#: Fixed names and order of the twelve canonical features.
CORE = [
    "median", "standard_deviation", "median_absolute_deviation", "amplitude", "percent_amplitude", "inter_percentile_range_25",
    "skew", "kurtosis", "stetson_K", "chi2", "eta", "maximum_slope",
]
TINY = 1e-12


def by_curve(keys: list[str]):
    return Window.partitionBy(*keys)


def in_time(keys: list[str]):
    """Order of time; equal times in the order of storage (src_idx), and where the source has none by magnitude and error."""
    return Window.partitionBy(*keys).orderBy("t", "src_idx", "m", "e")


def guarded(value: Column, when: Column) -> Column:
    return F.when(when, value).otherwise(F.lit(0.0))


def own_period() -> Column:
    """The period that points have in their metadata; null where there is none."""
    return F.try_element_at("metadata", F.lit("period")).cast("double")


def core_features(points: DataFrame, keys: list[str] = CURVE, passed: tuple[str, ...] = ()) -> DataFrame:
    """The twelve features of each curve, with n_points and the first value of the columns `passed`.

    Points with `metadata` also give their curve's period, under that name. Deviations are population ones. Features that divide by a vanishing spread, mean or time step are 0.
    """
    curve, time = by_curve(keys), in_time(keys)
    if "metadata" in points.columns and "period" not in (*points.columns, *passed):
        points, passed = points.withColumn("period", own_period()), (*passed, "period")
    p = clean(points)
    p = p.withColumn("__mean", F.avg("m").over(curve)).withColumn("__median", F.percentile("m", F.lit(0.5)).over(curve))
    p = p.withColumn("__dm", F.col("m") - F.lag("m").over(time)).withColumn("__dt", F.col("t") - F.lag("t").over(time))
    sigma, n = F.stddev_pop("m"), F.count("m")
    spread = sigma > TINY
    centred = F.col("m") - F.col("__mean")
    amplitude = (F.max("m") - F.min("m")) / 2
    q = F.percentile("m", F.array(F.lit(0.125), F.lit(0.875)))
    slope = F.max(F.when(F.col("__dt") > 0, F.abs(F.col("__dm") / F.col("__dt"))))
    return p.groupBy(*keys).agg(
        n.alias("n_points"),
        *(F.min(c).alias(c) for c in passed),
        F.max("__median").alias("median"),
        sigma.alias("standard_deviation"),
        F.percentile(F.abs(F.col("m") - F.col("__median")), F.lit(0.5)).alias("median_absolute_deviation"),
        amplitude.alias("amplitude"),
        guarded(amplitude / F.abs(F.avg("m")), F.abs(F.avg("m")) > TINY).alias("percent_amplitude"),
        (q[1] - q[0]).alias("inter_percentile_range_25"),
        guarded(F.avg(centred**3) / sigma**3, spread).alias("skew"),
        guarded(F.avg(centred**4) / sigma**4 - 3, spread).alias("kurtosis"),
        guarded(F.avg(F.abs(centred)) / sigma, spread).alias("stetson_K"),
        guarded(F.sum(centred**2) / sigma**2 / F.greatest(n - 1, F.lit(1)), spread).alias("chi2"),
        guarded(F.sum(F.col("__dm") ** 2) / ((n - 1) * sigma**2), spread & (n > 1)).alias("eta"),
        F.coalesce(slope, F.lit(0.0)).alias("maximum_slope"),
    )


def change_stats(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """Mean and maximum absolute change and deviation of changes between consecutive points."""
    p = clean(points).withColumn("__d", F.col("m") - F.lag("m").over(in_time(keys)))
    return p.groupBy(*keys).agg(F.avg(F.abs("__d")).alias("mean_abs_change"), F.stddev_pop("__d").alias("std_change"), F.max(F.abs("__d")).alias("max_abs_change"))


def cadence_stats(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """Mean, median and deviation of time steps, and the baseline."""
    p = clean(points).withColumn("__d", F.col("t") - F.lag("t").over(in_time(keys)))
    return p.groupBy(*keys).agg(
        F.avg("__d").alias("cadence_mean"),
        F.percentile("__d", F.lit(0.5)).alias("cadence_median"),
        F.stddev_pop("__d").alias("cadence_std"),
        (F.max("t") - F.min("t")).alias("baseline"),
    )


def cusum_range(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """The range of the running sum of z-scores; 0 for flat curves."""
    curve, time = by_curve(keys), in_time(keys).rowsBetween(Window.unboundedPreceding, 0)
    p = clean(points).withColumn("__s", F.stddev_pop("m").over(curve)).withColumn("__z", F.col("m") - F.avg("m").over(curve))
    p = p.withColumn("__c", F.sum(F.when(F.col("__s") > TINY, F.col("__z") / F.col("__s")).otherwise(0.0)).over(time))
    return p.groupBy(*keys).agg((F.max("__c") - F.min("__c")).alias("cusum_range"))


def pack_eleven(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """Counts, moments, percentiles, errors and the least-squares slope (0 with under three points or no time span)."""
    p = clean(points).withColumn("__median", F.percentile("m", F.lit(0.5)).over(by_curve(keys)))
    q = F.percentile("m", F.array(*map(F.lit, (0.1, 0.25, 0.75, 0.9))))
    slope = F.when((F.count("m") >= 3) & (F.max("t") > F.min("t")), F.regr_slope("m", "t"))
    return p.groupBy(*keys).agg(
        F.count("m").alias("n"), F.avg("m").alias("mean"), F.max("__median").alias("median"), F.stddev_pop("m").alias("std"),
        q[0].alias("p10"), q[1].alias("p25"), q[2].alias("p75"), q[3].alias("p90"), (q[2] - q[1]).alias("iqr"),
        (q[3] - q[0]).alias("range_10_90"), (F.max("m") - F.min("m")).alias("amplitude"),
        F.percentile(F.abs(F.col("m") - F.col("__median")), F.lit(0.5)).alias("mad"),
        guarded(F.avg((F.col("m") - F.col("__median")) ** 3) / F.stddev_pop("m") ** 3, F.stddev_pop("m") > TINY).alias("skew_median"),
        F.avg("e").alias("error_mean"), F.percentile("e", F.lit(0.5)).alias("error_median"), F.stddev_pop("e").alias("error_std"),
        F.coalesce(slope, F.lit(0.0)).alias("slope"),
    )


def pack_weighted(points: DataFrame, keys: list[str] = CURVE) -> DataFrame:
    """Error-weighted statistics: weighted mean, weighted chi2, sample deviation, percentile ranges."""
    err = F.greatest(F.coalesce(F.abs("e"), F.lit(1.0)), F.lit(1e-6))
    p = clean(points).withColumn("__w", 1 / err**2)
    curve = by_curve(keys)
    p = p.withColumn("__wm", F.sum(F.col("__w") * F.col("m")).over(curve) / F.sum("__w").over(curve))
    q = F.percentile("m", F.array(*map(F.lit, (0.05, 0.2, 0.8, 0.95))))
    return p.groupBy(*keys).agg(
        F.max("__wm").alias("weighted_mean"), F.avg((F.col("m") - F.col("__wm")) ** 2 * F.col("__w")).alias("weighted_chi2"),
        F.stddev_samp("m").alias("std_sample"), (q[3] - q[0]).alias("range_5_95"), (q[2] - q[1]).alias("range_20_80"),
    )


def fourier_moments(points: DataFrame, period: Column | None = None, harmonics: int = 3, keys: list[str] = CURVE) -> DataFrame:
    """Sums for the least-squares fit of `harmonics` sines to the phase-folded curve, of magnitudes less their mean: one
    array `xtx` and one `xty`. Without `period` each curve is folded by its own, from its points' metadata."""
    p = clean(points).withColumn("__p", own_period() if period is None else period).where(finite("__p") & (F.col("__p") > 0))
    p = p.withColumn("m", F.col("m") - F.avg("m").over(by_curve(keys)))
    turn = 2 * F.pi() * F.pmod((F.col("t") - F.min("t").over(by_curve(keys))) / F.col("__p"), F.lit(1.0))
    p = p.withColumn("__x", F.array(F.lit(1.0), *(f(k * turn) for k in range(1, harmonics + 1) for f in (F.cos, F.sin))))
    size = 2 * harmonics + 1
    x = [F.col("__x")[i] for i in range(size)]
    return p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("m") ** 2).alias("yty"),
        F.array(*(F.sum(x[i] * x[j]) for i in range(size) for j in range(size))).alias("xtx"),
        F.array(*(F.sum(x[i] * F.col("m")) for i in range(size))).alias("xty"),
    )


def fourier_features(points: DataFrame, period: Column | None = None, harmonics: int = 3, keys: list[str] = CURVE) -> DataFrame:
    """Amplitudes, amplitude ratios and phase differences of the fit; null where it isn't determined."""
    size = 2 * harmonics + 1
    names = [*(f"amplitude_{k}" for k in range(1, harmonics + 1)), "residual_std", *(f"r{k}1" for k in range(2, harmonics + 1)), *(f"phi{k}1" for k in range(2, harmonics + 1))]

    def solve(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for n, yty, xtx, xty in zip(b["n"], b["yty"], b["xtx"], b["xty"], strict=True):
                a, y = np.array(xtx).reshape(size, size), np.array(xty)
                if n < 4 * harmonics or np.linalg.matrix_rank(a) < size:
                    rows.append([None] * len(names))
                    continue
                c = np.linalg.solve(a, y)
                amp, phase = np.hypot(c[1::2], c[2::2]), np.arctan2(c[2::2], c[1::2])
                rest = max(0.0, (yty - 2 * c @ y + c @ a @ c) / n) ** 0.5
                ratio = [float(x / amp[0]) if amp[0] > 1e-9 else None for x in amp[1:]]
                rows.append([*amp, rest, *ratio, *(float((phase[k] - (k + 1) * phase[0]) % (2 * np.pi)) for k in range(1, harmonics))])
            yield pd.concat([b[keys], pd.DataFrame(rows, columns=names, index=b.index)], axis=1)

    moments = fourier_moments(points, period, harmonics, keys)
    schema = ", ".join(f"{k} {moments.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", {n} double" for n in names)
    return moments.mapInPandas(solve, schema)
