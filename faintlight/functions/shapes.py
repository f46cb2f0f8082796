"""The shape of a curve: its standardised magnitudes at evenly spaced times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.curves import CURVE, clean
from faintlight.functions.features import TINY


def resampled(points: DataFrame, bins: int = 64, least: int = 10, keys: list[str] = CURVE) -> DataFrame:
    """(keys, bin, value): the curve at `bins` evenly spaced times from its first to its last, by straight lines.

    Of several points at one time the first by src_idx counts, then that of the smallest magnitude. Magnitudes are less
    their mean, over their population deviation. Curves with fewer than `least` different times, no time span or no
    deviation are left out.
    """
    curve = Window.partitionBy(*keys)
    first = F.min_by("m", F.struct(F.col("src_idx").isNull(), "src_idx", "m"))
    p = clean(points).groupBy(*keys, "t").agg(first.alias("m"))
    begin, end = F.min("t").over(curve), F.max("t").over(curve)
    p = p.select(
        *keys, ((F.col("t") - begin) / F.nullif(end - begin, F.lit(0.0))).alias("__x"), F.count("*").over(curve).alias("__n"),
        (F.col("m") - F.avg("m").over(curve)).alias("__c"), F.stddev_pop("m").over(curve).alias("__sd"),
    ).where((F.col("__n") >= least) & (F.col("__sd") > TINY))
    p = p.withColumn("__z", F.col("__c") / F.col("__sd"))
    time = curve.orderBy("__x")
    p = p.withColumn("__x2", F.lead("__x").over(time)).withColumn("__z2", F.lead("__z").over(time)).where("__x2 IS NOT NULL")
    # Each bin belongs to the line that begins at or before it; the last line also has the last bin.
    at = lambda x: F.ceil(F.col(x) * (bins - 1)).cast("int")
    last = F.when(F.col("__x2") == 1, F.lit(bins - 1)).otherwise(at("__x2") - 1)
    p = p.withColumn("__last", last).where(at("__x") <= F.col("__last"))
    p = p.withColumn("bin", F.explode(F.sequence(at("__x"), F.col("__last"))))
    way = (F.col("bin") / F.lit(float(bins - 1)) - F.col("__x")) / (F.col("__x2") - F.col("__x"))
    return p.select(*keys, "bin", (F.col("__z") + way * (F.col("__z2") - F.col("__z"))).alias("value"))
