"""Whole feature families: statistics of curves, or of all bands of an object one after the other, chosen and named by family.

All statistics come from one shuffle by key: windows and the aggregate work on the same partitions. One curve's points are
in one task, as curves hold the observations of one object in one band.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.curves import CURVE, clean, finite, longest_band
from faintlight.functions.features import TINY, own_period
from faintlight.functions.shapes import resampled

OBJECT = ["id_objeto"]
#: Fixed order in which an object's bands follow each other.
BANDS = ("g", "r", "i")
MODES = ("period", "observation", "statistics", "shape", "shape_period", "all")


def period_of(points: DataFrame) -> Column:
    """The points' own period, by a column `period` or else by their metadata; null where neither has one."""
    if "period" in points.columns:
        return F.col("period").cast("double")
    if "metadata" in points.columns:
        return own_period()
    return F.lit(None).cast("double")


def statistics(points: DataFrame, keys: Sequence[str] = CURVE, bands: Sequence[str] = BANDS, step: str | None = None) -> DataFrame:
    """All statistics that families choose from, a row for each key.

    Changes follow the order of storage (band by band, then src_idx, then time), steps the order of time. `step` names a
    column with each point's own time step: then own_slope is the largest change over the later point's step, among
    points whose step is above 0, and own_step_* describe these steps. What divides by a spread of 0 is 0; what needs an
    error or a step where there is none is null. Points that aren't finite and other bands count for nothing.
    """
    curve = Window.partitionBy(*keys)
    band = F.array_position(F.array(*map(F.lit, bands)), F.col("banda"))
    stored, time = curve.orderBy(band, "src_idx", "t", "m", "e"), curve.orderBy("t", "src_idx", "m", "e")
    m, sigma = F.col("m"), F.col("__sigma")
    p = clean(points.withColumn("__period", period_of(points))).where(F.col("banda").isin(*bands))
    p = p.withColumns({
        "__mean": F.avg("m").over(curve), "__median": F.percentile("m", F.lit(0.5)).over(curve), "__std": F.stddev_pop("m").over(curve),
        "__sigma": F.when(F.col("e") > 0, F.col("e")), "__floor": 1 / F.greatest(F.col("e"), F.lit(1e-6)) ** 2,
        "__change": m - F.lag("m").over(stored), "__timed": m - F.lag("m").over(time), "__step": F.col("t") - F.lag("t").over(time),
    })
    moving = F.col("__std") > TINY
    p = p.withColumns({
        "__z": F.when(moving, (m - F.col("__mean")) / F.col("__std")).otherwise(0.0),
        "__weighted": F.sum(m / sigma**2).over(curve) / F.sum(1 / sigma**2).over(curve), "__known": F.avg(F.when(sigma.isNotNull(), m)).over(curve),
    })
    p = p.withColumn("__sum", F.sum("__z").over(stored.rowsBetween(Window.unboundedPreceding, 0)))
    own: list[Column] = []
    if step:
        held = F.when(F.col(step) > 0, F.struct(m.alias("m"), F.col(step).cast("double").alias("step")))
        p = p.withColumn("__held", held).withColumn("__before", F.last(F.when(F.col(step) > 0, m), ignorenulls=True).over(stored.rowsBetween(Window.unboundedPreceding, -1)))
        steps = F.col("__held.step")
        own = [
            F.coalesce(F.max(F.abs((F.col("__held.m") - F.col("__before")) / steps)), F.lit(0.0)).alias("own_slope"),
            F.avg(steps).alias("own_step_mean"), F.percentile(steps, F.lit(0.5)).alias("own_step_median"), F.stddev_pop(steps).alias("own_step_std"),
        ]
    shares = (0.05, 0.10, 0.20, 0.25, 0.75, 0.80, 0.90, 0.95)
    q = F.percentile("m", F.array(*map(F.lit, shares)))
    n, z, flat = F.count("*"), F.col("__z"), F.max("__std") <= TINY
    known, weighted = (m - F.col("__known")) / sigma, (m - F.col("__weighted")) / sigma
    centred = (m - F.col("__mean")) / sigma
    changes, square = F.sum(F.col("__change") ** 2), F.sum((m - F.col("__mean")) ** 2)
    return p.groupBy(*keys).agg(
        n.alias("n"), F.avg("m").alias("mean"), F.max("__median").alias("median"), F.stddev_pop("m").alias("std"), F.stddev_samp("m").alias("std_sample"),
        F.percentile(F.abs(m - F.col("__median")), F.lit(0.5)).alias("mad"), F.min("m").alias("min"), F.max("m").alias("max"), (F.max("m") - F.min("m")).alias("range"),
        *(q[i].alias(f"p{round(100 * s):02d}") for i, s in enumerate(shares)),
        F.avg(z**3).alias("skew"), F.when(flat, 0.0).otherwise(F.avg(z**4) - 3).alias("kurtosis"),
        F.when(flat, 0.0).otherwise(F.avg(F.when(moving, (m - F.col("__median")) / F.col("__std")) ** 3)).alias("skew_median"),
        F.coalesce(F.try_divide(F.avg(F.abs(z)), F.sqrt(F.avg(z**2))), F.lit(0.0)).alias("stetson_k"),
        F.coalesce(F.try_divide(F.avg(F.abs(centred)), F.sqrt(F.avg(centred**2))), F.lit(0.0)).alias("stetson_k_error"),
        (F.sum(F.col("__floor") * m) / F.sum("__floor")).alias("weighted_mean"),
        F.when(F.count(sigma) > 1, F.avg(weighted**2)).otherwise(0.0).alias("chi2_weighted"), F.coalesce(F.avg(known**2), F.lit(0.0)).alias("chi2_error"),
        F.when(flat | (n < 2), 0.0).otherwise(changes / ((n - 1) * F.max("__std") ** 2)).alias("eta"), F.when(flat | (n < 2), 0.0).otherwise(changes / square).alias("eta_square"),
        F.avg(F.abs("__change")).alias("change_mean"), F.stddev_pop("__change").alias("change_std"), F.max(F.abs("__change")).alias("change_max"),
        (F.max("__sum") - F.min("__sum")).alias("cusum"),
        F.when((n >= 2) & (F.max("t") > F.min("t")), F.regr_slope("m", "t")).alias("slope"),
        F.coalesce(F.max(F.when(F.col("__step") != 0, F.abs(F.col("__timed") / F.col("__step")))), F.lit(0.0)).alias("maximum_slope"),
        F.avg("e").alias("error_mean"), F.percentile("e", F.lit(0.5)).alias("error_median"), F.stddev_pop("e").alias("error_std"),
        F.avg("__step").alias("cadence_mean"), F.percentile("__step", F.lit(0.5)).alias("cadence_median"), F.stddev_pop("__step").alias("cadence_std"),
        (F.max("t") - F.min("t")).alias("span"), *own, F.max("__period").alias("period"),
    )


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def _least(n: int, name: str, other: float | None = None) -> Column:
    return F.when(F.col("n") >= n, F.col(name)).otherwise(F.lit(other).cast("double"))


def _columns(*names: str, **made: Column) -> dict[str, Column]:
    return {name: F.col(name) for name in names} | made


def by_band(curves: DataFrame, columns: Mapping[str, Column], bands: Sequence[str] = BANDS, period: bool = True) -> DataFrame:
    """A row for each object: the columns of each band under the band's name, null where it has no such band, and its period."""
    made = curves.select("id_objeto", "banda", "period", *(c.alias(name) for name, c in columns.items()))
    wide = [F.max(F.when(F.col("banda") == b, F.col(name))).alias(f"{b}_{name}") for b in bands for name in columns]
    return made.groupBy("id_objeto").agg(*wide, *([F.max("period").alias("period")] if period else []))


def eleven(points: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """21 statistics of each band and the period: points with a finite error only; skew about the median; a slope of 0 for
    under three points or no time span, steps of 0 for a single point."""
    columns = _columns("n", "mean", "median", "std", "p10", "p25", "p75", "p90", "mad", "error_mean", "error_median", "error_std", iqr=F.col("p75") - F.col("p25"),
        range_10_90=F.col("p90") - F.col("p10"), amplitude=F.col("range"), skew=F.col("skew_median"), cadence_mean=_zero("cadence_mean"),
        cadence_median=_zero("cadence_median"), cadence_std=_zero("cadence_std"), baseline=F.col("span"), slope=F.coalesce(_least(3, "slope"), F.lit(0.0)))
    return by_band(statistics(points.where(finite("e")), bands=bands), columns, bands)


def twelve(points: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """17 statistics of each band; the slope is null for fewer than three points."""
    columns = _columns("n", "mean", "std", "median", "mad", "min", "max", "p10", "p90", "error_mean", "error_std", "error_median", "cadence_mean", "cadence_std",
        amplitude=F.col("p95") - F.col("p05"), iqr=F.col("p75") - F.col("p25"), slope=_least(3, "slope"))
    return by_band(statistics(points, bands=bands), columns, bands, period=False)


def thirteen(points: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """16 statistics of each band and the period; what a single point doesn't have is 0."""
    snr = F.when(F.col("error_mean") > 0, F.col("std") / F.col("error_mean")).otherwise(0.0)
    columns = _columns("mean", "std", "median", "p05", "p25", "p75", "p95", "mad", "n", amplitude=F.col("range"), iqr=F.col("p75") - F.col("p25"), slope=_zero("slope"),
        time_span=F.col("span"), mean_error=_zero("error_mean"), snr=snr, std_diff=_zero("change_std"))
    return by_band(statistics(points, bands=bands), columns, bands)


def fifteen(points: DataFrame, bands: Sequence[str] = BANDS, relative: bool = False) -> DataFrame:
    """27 statistics of all bands of an object together. With `relative`, those that hold the absolute level or scale are
    null, and four ratios stand beside the rest."""
    s = statistics(points.where(finite("e")), OBJECT, bands)
    half = F.col("range") / 2
    columns = _columns("mean", "median", "weighted_mean", "min", "max", "change_mean", "change_std", "change_max", "error_mean", "error_median", "error_std", "n",
        "cadence_mean", "cadence_median", "cadence_std", std=_least(2, "std"), mad=_least(2, "mad"), p25=_least(2, "p25"), p75=_least(2, "p75"), range=_least(2, "range"),
        iqr=F.when(F.col("n") >= 2, F.col("p75") - F.col("p25")), skew=_least(3, "skew"), kurtosis=_least(3, "kurtosis"), cusum=_least(2, "cusum"),
        amplitude=F.when(F.col("n") >= 2, half), percent_amplitude=F.when(F.col("n") >= 2, half / F.greatest(F.abs("median"), F.lit(1e-6))))
    made = s.select("id_objeto", *(c.alias(name) for name, c in columns.items()))
    return without_scale(made) if relative else made


def without_scale(features: DataFrame) -> DataFrame:
    """Features of `fifteen` without level and scale: those are null; spread, quartiles and changes over the amplitude and the
    errors' spread over the magnitudes' come instead (divisors of 1e-6 at least)."""
    absolute = ("mean", "median", "weighted_mean", "min", "max", "p25", "p75", "error_mean", "error_median")
    over = lambda a, b: F.col(a) / F.greatest(F.abs(b), F.lit(1e-6))
    return features.withColumns({
        "std_relative": over("std", "amplitude"), "iqr_relative": over("iqr", "amplitude"), "change_relative": over("change_mean", "amplitude"), "error_relative": over("error_std", "std"),
    }).withColumns({c: F.lit(None).cast("double") for c in absolute})


def sixteen(points: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """Ten statistics of each band's magnitudes less their median, over their MAD (else their deviation, else 1).

    Times and errors don't matter; points with a finite magnitude count, whatever else they hold."""
    curve = Window.partitionBy(*CURVE)
    p = points.where(finite("m")).withColumns({"t": F.lit(0.0), "e": F.lit(None).cast("double"), "__c": F.col("m") - F.percentile("m", F.lit(0.5)).over(curve)})
    mad, std = F.percentile(F.abs("__c"), F.lit(0.5)).over(curve), F.stddev_pop("m").over(curve)
    p = p.withColumn("__scale", F.when(mad > TINY, mad).when(std > TINY, std).otherwise(1.0)).withColumn("m", F.col("__c") / F.col("__scale")).drop("__c", "__scale")
    columns = _columns("mean", "std", "p10", "p25", "median", "p75", "p90", "skew", "mad", range_10_90=F.col("p90") - F.col("p10"))
    return by_band(statistics(p, bands=bands), columns, bands, period=False)


def seventeen(points: DataFrame, bands: Sequence[str] = BANDS, step: str | None = None) -> DataFrame:
    """22 statistics of each band, then their mean over an object's bands: sample deviation, amplitude in percent of the
    mean, percentile ranges, chi squared about the weighted mean. Slopes and steps are those of the column `step` where
    one is given, else those between neighbours in time."""
    s = statistics(points, bands=bands, step=step)
    steps = {f"step_{k}": _zero(f"own_step_{k}" if step else f"cadence_{k}") for k in ("mean", "median", "std")}
    columns = _columns("mean", "median", "mad", "stetson_k", "eta", "n", chi2=F.col("chi2_weighted"), std=_zero("std_sample"), amplitude=F.col("range"),
        percent_amplitude=100 * F.col("range") / F.greatest(F.abs("mean"), F.lit(TINY)), range_5_95=F.col("p95") - F.col("p05"), range_20_80=F.col("p80") - F.col("p20"),
        skew=_least(3, "skew", 0.0), kurtosis=_least(3, "kurtosis", 0.0), maximum_slope=F.col("own_slope" if step else "maximum_slope"),
        error_mean=_zero("error_mean"), error_median=_zero("error_median"), error_std=_zero("error_std"), **steps)
    return s.select("id_objeto", *(c.alias(name) for name, c in columns.items())).groupBy("id_objeto").agg(*(F.avg(name).alias(name) for name in columns))


def eighteen(points: DataFrame, bands: Sequence[str] = BANDS) -> DataFrame:
    """13 statistics of all bands of an object together, with chi squared and Stetson's K weighed by errors above 0."""
    s = statistics(points, OBJECT, bands)
    columns = _columns("mean", "median", "mad", "maximum_slope", std=_zero("std_sample"), amplitude=F.col("range"), percent_amplitude=F.col("range") / F.greatest(F.abs("median"), F.lit(TINY)),
        ipr=F.col("p75") - F.col("p25"), skew=_least(3, "skew", 0.0), kurtosis=_least(4, "kurtosis", 0.0), stetson_k=_least(3, "stetson_k_error", 0.0),
        eta=F.col("eta_square"), chi2=_least(2, "chi2_error", 0.0))
    return s.select("id_objeto", *(c.alias(name) for name, c in columns.items()))


def fourteen(points: DataFrame, mode: str = "all", bands: Sequence[str] = BANDS, bins: int = 64, least: int = 10) -> DataFrame:
    """Features of an object's longest band by mode: period, eight of observation, eleven statistics, the shape in `bins`
    columns, shape and period, or all. Objects with fewer than `least` points in that band are left out, and in modes with a
    shape those whose curve has none; a missing period is 0. Of bands equally long the first of `bands` counts."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {', '.join(MODES)}")
    p = points.where(finite("e") & F.col("banda").isin(*bands))
    longest = longest_band(clean(p), bands).select(F.col("id_objeto").alias("__id"), F.col("banda").alias("__band"))
    p = p.join(longest, F.col("id_objeto").eqNullSafe(F.col("__id")) & (F.col("banda") == F.col("__band"))).drop("__id", "__band")
    period = {"period": F.when(finite("period"), F.col("period")).otherwise(0.0)}
    observation = _columns("n", "error_mean", "error_median", "error_std", duration=F.col("span"), **{f"cadence_{k}": _zero(f"cadence_{k}") for k in ("mean", "median", "std")})
    level = _columns("mean", "std", "mad", "p05", "p25", "median", "p75", "p95", amplitude=F.col("range"), range_5_95=F.col("p95") - F.col("p05"), iqr=F.col("p75") - F.col("p25"))
    chosen = {"period": period, "observation": observation, "statistics": level, "shape": {}, "shape_period": period, "all": period | observation | level}[mode]
    made = statistics(p, OBJECT, bands).where(F.col("n") >= least).select("id_objeto", *(c.alias(name) for name, c in chosen.items()))
    if mode not in ("shape", "shape_period", "all"):
        return made
    shape = resampled(p, bins, least, OBJECT).groupBy("id_objeto").agg(*(F.max(F.when(F.col("bin") == i, F.col("value"))).alias(f"shape_{i}") for i in range(bins)))
    return made.join(shape, "id_objeto")
