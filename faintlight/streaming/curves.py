"""Running moments of curves over a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlight.curves import CURVE, clean


def moments(points: DataFrame, time: str = "ts", late: str = "1 day", window: str = "7 days") -> DataFrame:
    """Count, mean, deviation and range of each curve's magnitudes per window of event time; works on batches too."""
    p = points.withWatermark(time, late) if points.isStreaming else points
    return clean_stream(p).groupBy(F.window(time, window), *CURVE).agg(
        F.count("m").alias("n"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), (F.max("m") - F.min("m")).alias("range")
    )


def clean_stream(points: DataFrame) -> DataFrame:
    return clean(points)
