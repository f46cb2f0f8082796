"""Samples, splits and permutations that are drawn by hashes, so that every run and engine draws the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.operators.stats import hash_order


def sampled(frame: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement, the first by a hash of the key; all if there are fewer."""
    return frame.orderBy(hash_order(F.col(key), seed), key).limit(n)


def group_split(frame: DataFrame, group: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """Adds is_test, the same for all rows of a group, for about `share` of the groups; no group is on both sides."""
    draw = F.conv(F.substring(hash_order(F.col(group), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return frame.withColumn("is_test", draw < share)


def permuted(frame: DataFrame, key: str, column: str, within: list[str], seed: str = "42") -> DataFrame:
    """The frame with the values of a column dealt out anew within each group: the values in order of a hash of the key
    go to the rows in order of the key."""
    here = Window.partitionBy(*within)
    rows = frame.withColumn("__n", F.row_number().over(here.orderBy(key)))
    values = frame.select(*(F.col(w).alias(f"__of_{w}") for w in within), F.col(column).alias("__value"), F.row_number().over(here.orderBy(hash_order(F.col(key), seed), key)).alias("__m"))
    same = [F.col(w).eqNullSafe(F.col(f"__of_{w}")) for w in within]
    return rows.join(values, [*same, F.col("__n") == F.col("__m")]).withColumn(column, F.col("__value")).select(*frame.columns)


def permutation_control(rows: DataFrame, key: str, score: str, label: str, within: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(seed, agreement): the mean of score where label is 1 less that where it is 0, after each of several permutations
    of the labels within a group; near 0 unless the groups alone explain the scores."""
    out = None
    for s in range(seed, seed + repeats):
        x = permuted(rows, key, label, [within], str(s)).agg((F.avg(F.when(F.col(label) == 1, F.col(score))) - F.avg(F.when(F.col(label) == 0, F.col(score)))).alias("agreement"))
        x = x.select(F.lit(s).alias("seed"), "agreement")
        out = x if out is None else out.union(x)
    return out
