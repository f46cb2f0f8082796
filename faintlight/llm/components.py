"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlight.llm.store import dropped, written


def components(links: DataFrame, used: list[str] | None = None) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node that can be reached.

    Each round gives a node the smallest label around it and then the label of that label, so labels travel twice as
    far with each round. Joins on a node with very many links are inner ones, which Spark splits where they are skewed.
    Null ends link nothing; repeated links and links from a node to itself change nothing; no links give no rows.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    ends: list[str] = []
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), ends)
    old: list[str] = []
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), old)
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        nearest = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        step = labels.join(nearest, "node").select("node", "label", F.least("label", "near").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("then"))
        step = step.join(jump, "now", "left").select("node", "label", F.least("now", "then").alias("now"))
        new: list[str] = []
        step = written(step, new)
        labels = step.select("node", F.col("now").alias("label"))
        dropped(links.sparkSession, old)
        old = new
        if step.where("label <> now").isEmpty():
            dropped(links.sparkSession, ends)
            if used is not None:
                used += old
            return labels
