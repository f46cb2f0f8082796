"""Greedy one-to-one matching of candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.operators import neighbours
from faintlight.operators.order import quantiles_of
from faintlight.operators.tables import set_checkpoints


def close_pairs(pairs: DataFrame, factor: float = 1.5) -> DataFrame:
    """Pairs whose distance is at most factor times the first quartile of all distances."""
    quartile = quantiles_of(pairs, {"__q": F.col("distance")}, [0.25])
    return pairs.join(F.broadcast(quartile), F.col("distance") <= factor * F.col("__q")[0]).drop("__q")


def greedy_match(pairs: DataFrame) -> DataFrame:
    """(id, neighbour, distance): what taking pairs by rising distance gives when each id and neighbour is used once.

    Pairs that are the best of both their ends are taken at the same time, which gives the pairs that one sequence
    would take; their ends then leave. Ties go to the smaller id, then to the smaller neighbour. Pairs with nulls or a
    distance that is NaN are left out, repeated pairs count once, and no pairs give no rows.
    """
    set_checkpoints(pairs.sparkSession)
    left = pairs.select("id", "neighbour", "distance").where("NOT isnan(distance)").dropna().distinct().checkpoint()
    order = F.struct("distance", "id", "neighbour")
    taken = left.limit(0)
    while not left.isEmpty():
        best = lambda end: F.min(order).over(Window.partitionBy(end)) == order
        now = left.withColumn("a", best("id")).withColumn("b", best("neighbour")).where("a AND b").drop("a", "b").checkpoint()
        left = left.join(now.select("id"), "id", "left_anti").join(now.select("neighbour"), "neighbour", "left_anti")
        left = left.select("id", "neighbour", "distance").checkpoint()
        taken = taken.union(now)
    return taken


def match_all(queries: DataFrame, points: DataFrame, k: int = 20, factor: float = 1.5) -> DataFrame:
    """What greedy_match() gives for all pairs of queries and points (id, v) within the distance bound.

    The bound is that of close_pairs() for the k nearest points of each query. Otherwise k is only the size of the first
    batch: pairs that a query's list doesn't hold come after the last pair in it, so what is taken up to the last pair
    of the first list that is used up is final. The ends left over then look for twice as many of the points left.
    """
    set_checkpoints(queries.sparkSession)
    near = neighbours.nearest(queries, points, k).checkpoint()
    quartile = (quantiles_of(near, {"q": F.col("distance")}, [0.25]).first()[0] or [None])[0]
    order = F.struct("distance", "id", "neighbour")
    taken = near.select("id", "neighbour", "distance").limit(0)
    while quartile is not None:
        close = near.where(F.col("distance") <= factor * quartile)
        now = greedy_match(close).checkpoint()
        lists = close.groupBy("id").agg(F.count("*").alias("n"), F.max(order).alias("last")).where(F.col("n") >= k)
        end = lists.join(now.select("id"), "id", "left_anti").agg(F.min("last")).first()[0]
        if end is None:
            return taken.union(now)
        last = F.struct(*(F.lit(end[c]).cast(near.schema[c].dataType).alias(c) for c in ("distance", "id", "neighbour")))
        now = now.where(order <= last).checkpoint()
        taken = taken.union(now)
        queries = queries.join(now.select("id"), "id", "left_anti").checkpoint()
        points = points.join(now.select(F.col("neighbour").alias("id")), "id", "left_anti").checkpoint()
        k *= 2
        near = neighbours.nearest(queries, points, k).checkpoint()
    return taken
