"""Ways to clean columns of features, and to bring two frames to the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlight.operators import order


def finite(column: str) -> Column:
    """The value where it is neither null nor NaN nor infinite, else null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def known(column: str) -> Column:
    """The value where it is neither null nor NaN, else null; infinite values stay."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def _filled(frame: DataFrame, medians: DataFrame, columns: list[str], value, last) -> DataFrame:
    return frame.join(F.broadcast(medians)).withColumns({c: last(F.coalesce(value(c), F.col(f"__{c}")[0])) for c in columns}).select(*frame.columns)


def medians(frame: DataFrame, columns: list[str], value=finite) -> DataFrame:
    """One row with an array of the median of each column's values, named with two underscores before."""
    return order.quantiles_of(frame, {f"__{c}": value(c) for c in columns}, [0.5])


def fill_then_zero(frame: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """NaN becomes the median of train first, then what is still not finite becomes 0."""
    found = medians(frame.where(train), columns, known)
    zero = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(0.0))
    return _filled(frame, found, columns, known, zero)


def fill_by_own_medians(frame: DataFrame, columns: list[str]) -> DataFrame:
    """What is not finite becomes the median of the frame's own finite values, or 0 if there is none."""
    return _filled(frame, medians(frame, columns), columns, finite, lambda x: F.coalesce(x, F.lit(0.0)))


def zero_filled(frame: DataFrame, columns: list[str]) -> DataFrame:
    """What is not finite becomes 0."""
    return frame.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in columns})


def median_filled(frame: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Nulls and NaN become the median of train's finite values; null if there is none."""
    return _filled(frame, medians(frame.where(train), columns), columns, known, lambda x: x)


def nulled(frame: DataFrame, columns: list[str]) -> DataFrame:
    """What is not finite becomes null."""
    return frame.withColumns({c: finite(c) for c in columns})


def whole_columns(frame: DataFrame, columns: list[str]) -> list[str]:
    """The columns without a value that is not finite; the frame is read once."""
    bad = frame.agg(*(F.count_if(finite(c).isNull()).alias(c) for c in columns)).first()
    return [c for c in columns if not bad[c]]


def aligned(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with these columns in this order; missing ones are null."""
    return frame.select(*(F.col(c) if c in frame.columns else F.lit(None).cast("double").alias(c) for c in columns))


def clipped_out(frame: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The rows whose value lies between two percentiles of the column."""
    bounds = order.quantiles_of(frame, {"__b": F.col(column)}, [low, high])
    return frame.join(F.broadcast(bounds), F.col(column).between(F.col("__b")[0], F.col("__b")[1])).drop("__b")


def truncated(*arrays: Column) -> list[Column]:
    """The arrays cut to the length of the shortest; null if one of them is null."""
    n = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    some = arrays[0].isNotNull()
    for a in arrays[1:]:
        some = some & a.isNotNull()
    return [F.when(some, F.slice(a, 1, n)) for a in arrays]


def scan_quality(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n, n_nan, n_inf, min, max, mean, std, constant) of each column, over its finite values."""
    pieces = []
    for c in columns:
        v, f = F.col(c).cast("double"), finite(c)
        pieces.append(
            F.struct(
                F.lit(c).alias("variable"), F.count(f).alias("n"), F.count_if(v.isNull() | F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf"),
                F.min(f).alias("min"), F.max(f).alias("max"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"), (F.min(f) == F.max(f)).alias("constant"),
            )
        )
    return frame.agg(F.array(*pieces).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def truthy(frame: DataFrame, column: str) -> DataFrame:
    """The rows whose text, as CSV files hold truth values, says true; others and nulls go."""
    return frame.where(F.lower(F.trim(F.col(column).cast("string"))).isin("true", "1", "yes"))
