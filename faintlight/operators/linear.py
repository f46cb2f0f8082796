"""Covariances of many columns in one pass, and what follows from them: correlations, components, scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, without rows that have a null, NaN or infinite value in one."""
    values = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    for i in range(len(columns)):
        values = values.where(~F.isnan(f"c{i}") & (F.abs(f"c{i}") < float("inf")))
    return values


def _sums(batches: Iterator[pa.RecordBatch], origin: np.ndarray) -> Iterator[pa.RecordBatch]:
    d = len(origin)
    total = np.zeros((d + 1, d + 1))
    for batch in batches:
        if batch.num_rows:
            x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False) - o for c, o in zip(batch.columns, origin, strict=True))])
            total += x.T @ x
    i, j = np.triu_indices(d + 1)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])


@dataclass
class Moments:
    """Number, means and covariance (divisor n) of columns."""

    columns: list[str]
    n: int
    mean: np.ndarray
    covariance: np.ndarray

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.diag(self.covariance))

    @property
    def correlation(self) -> np.ndarray:
        """Null (NaN) where a column doesn't vary."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.covariance / np.outer(self.deviation, self.deviation)


def moments(rows: DataFrame, columns: list[str]) -> Moments:
    """Means and covariances of the columns, over rows that have finite values in all of them.

    One pass: tasks add up products of the values less those of some row, which keeps the sums small against the
    spread, and the sums are added by key. The driver gets a number for each pair of columns, whatever the rows.
    """
    values = _whole(rows, columns)
    some = values.first()
    if some is None:
        return Moments(columns, 0, np.full(len(columns), np.nan), np.full((len(columns),) * 2, np.nan))
    origin = np.array(list(some), dtype=float)
    found = values.mapInArrow(partial(_sums, origin=origin), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    s = np.zeros((len(columns) + 1,) * 2)
    for r in found.collect():
        s[r["i"], r["j"]] = s[r["j"], r["i"]] = r["s"]
    n, shift = int(s[0, 0]), s[0, 1:] / s[0, 0]
    return Moments(columns, n, origin + shift, s[1:, 1:] / n - np.outer(shift, shift))


def correlations(rows: DataFrame, columns: list[str], limits: tuple[float, ...] = (0.75, 0.9)) -> DataFrame:
    """(a, b, r, band) of each pair of columns: `band` is how many of the limits the absolute value reaches."""
    r = moments(rows, columns).correlation
    pairs = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    frame = rows.sparkSession.createDataFrame(pairs, "a string, b string, r double")
    return frame.withColumn("band", sum((F.when(F.abs("r") >= x, 1).otherwise(0) for x in limits), F.lit(0)))


@dataclass
class Components:
    """Principal components of standardised columns, the largest first; each vector's largest entry is above 0."""

    columns: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def ratios(self) -> np.ndarray:
        return self.values / self.values.sum()

    def needed(self, target: float) -> int | None:
        """How many components reach this share of the variance together; None if all don't."""
        reached = np.flatnonzero(np.cumsum(self.ratios) >= target - 1e-12)
        return int(reached[0]) + 1 if len(reached) else None

    def scores(self, rows: DataFrame, k: int, prefix: str = "pc") -> DataFrame:
        """The rows with their first k scores, as plain columns; null where a column is null, NaN or infinite."""

        def entry(c: str, i: int) -> Column:
            x = F.col(c).cast("double")
            return (F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x) - float(self.mean[i])) / float(self.deviation[i])

        add = {f"{prefix}{j + 1}": sum((entry(c, i) * float(self.vectors[i, j]) for i, c in enumerate(self.columns)), F.lit(0.0)) for j in range(k)}
        return rows.withColumns(add)


def components(rows: DataFrame, columns: list[str]) -> Components:
    """Principal components of the columns, standardised; columns that don't vary are left out."""
    found = moments(rows, columns)
    live = [i for i in range(len(columns)) if found.deviation[i] > 0]
    values, vectors = np.linalg.eigh(found.correlation[np.ix_(live, live)])
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(live))]) if live else np.ones(0)
    return Components([columns[i] for i in live], found.mean[live], found.deviation[live], values, vectors * signs)


def variance_table(spark, found: Components, k: int) -> DataFrame:
    """(component, ratio, cumulative) of the first k components."""
    rows = [(i + 1, float(r), float(c)) for i, (r, c) in enumerate(zip(found.ratios[:k], np.cumsum(found.ratios)[:k], strict=True))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")
