"""Mixing sources to target weights by weighted fair queueing (operator 3)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.sharding import hash60
from faintlight.llm.store import clear_of, small, written

PER_BUCKET = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running_totals(frame: DataFrame, group: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running total of `value` within each group, in the order of bucket and then of `order`.

    No task sees a whole group: totals run within a bucket and start from the sum of the buckets before it.
    """
    keys = [*group, bucket]
    sums = frame.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0))).drop("__sum"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for k in keys:
        sums = sums.withColumnRenamed(k, f"__{k}")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    total = frame.withColumn("__within", F.sum(value).over(within)).join(sums, same)
    return total.withColumn(name, F.col("__before") + F.col("__within")).drop("__before", "__within", *(f"__{k}" for k in keys))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources, by code point and null last, get the weights in turn. Together they get `share` times all sizes, in
    proportion to their weights, but none more than `most` times its own size: what goes beyond is shared again by
    weight. Sources in order of limit per weight reach their limits one after the other, so the level that the others
    get per unit of weight follows from running sums.
    """
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(everyone) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    full, here_on = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(full), F.lit(0.0))) / F.sum("weight").over(here_on))
    # The level is that of the first source which stays under its limit; from there on it is the same for all.
    first = F.first(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.col("level")), ignorenulls=True).over(whole)
    return t.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("weight") * first, F.col("limit"))).alias("target"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """What a mix of the sources takes of each row: docs with size, source_size, target and copies.

    Each source's rows stand in shuffled order, `most` (rounded up) times one after the other. A row's virtual finish
    time is the words of its source up to and including it, divided by the source's target. All queues are served by
    finish time, until the sum of all targets is reached; so each source is taken in proportion to its target, and
    what it gets differs from the target by about one document. `copies` says how often the row is taken.

    The size is the number of words (null: 0); rows of size 0 are never taken. A null source is a source like any
    other. Repeated rows and rows without an id are shuffled by id, checksum of the text and size; equal ones stand next
    to each other and are taken alike. Whole texts are counted, however long. Empty tables stay empty. Columns of docs
    that bear the added names get `input_` before them.

    Texts are never shuffled: what is taken of a source is the first part of its queue, so one row for each source
    that says how far it goes decides for all documents where they stand.
    """
    docs = clear_of(docs, ("size", "source_size", "target", "copies"))
    text, id_ = F.col(text_col), F.col(id_col).cast("long")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).cast("string").alias("__source"),
        n_words(text).alias("size"), id_.alias("__id"), F.crc32(text.cast("binary")).alias("__crc"),
    )
    # Rows without an id are shuffled by what else they hold, so that they don't all stand in one place.
    order = F.when(F.col("__id").isNotNull(), hash60(F.col("__id"), F.lit(seed))).otherwise(hash60(F.col("__id"), F.lit(seed), F.col("__crc"), F.col("size")))
    rows = rows.withColumn("__order", order)
    keyed = written(rows.groupBy("__source", "size", "__order", "__id", "__crc").agg(F.count("*").alias("__rows")))
    sizes = written(keyed.groupBy(F.col("__source").alias("source")).agg(F.sum(F.col("size") * F.col("__rows")).cast("long").alias("source_size")))
    goal = written(targets(sizes, weights, share, most))
    buckets = max(1, math.ceil(keyed.count() / PER_BUCKET))
    queue = keyed.where("size > 0")
    queue = queue.withColumn("__bucket", F.floor(F.col("__order") / F.lit((1 << 60) // buckets + 1)).cast("long"))
    queue = queue.withColumn("__words", F.col("size") * F.col("__rows"))
    queue = running_totals(queue, ["__source"], "__bucket", ["__order", "__id", "__crc", "size"], "__words", "__end")
    queue = queue.withColumnRenamed("__bucket", "__place").join(goal, F.col("__source").eqNullSafe(F.col("source"))).drop("source")
    # Rows that are wholly alike stand one after the other in their queue; __end is where the last of them ends.
    queue = queue.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.lit(math.ceil(most)))))
    queue = queue.withColumn("__finish", (F.col("__end") + (F.col("__nth") - 1) * F.col("source_size")) / F.col("target"))
    queue = written(queue.withColumn("__slice", F.floor(F.col("__finish") * buckets).cast("long")))
    budget = goal.agg(F.sum("target")).first()[0] or 0.0
    served = running_totals(
        queue, [], "__slice", ["__finish", "__source", "__nth", "__order", "__id", "__crc"], "__words", "__total"
    )
    place = F.struct("__nth", "__order", "__id", "__crc", "size")
    ends = served.where(F.col("__total") <= budget).groupBy(F.col("__source").alias("source")).agg(F.max(place).alias("end"))
    goal = goal.join(written(ends).withColumnRenamed("source", "__ended"), F.col("source").eqNullSafe(F.col("__ended")), "left").drop("__ended")
    goal = goal.select(F.struct("source", "source_size", "target", "end").alias("__goal"))
    key = ("__order", "__id", "__crc", "size")
    reached = F.struct(*key) <= F.struct(*(F.col(f"__goal.end.{c}").alias(c) for c in key))
    copies = F.when(F.col("size") > 0, F.col("__goal.end.__nth") - F.when(reached, 0).otherwise(1))
    return rows.join(small(goal, 100_000), F.col("__source").eqNullSafe(F.col("__goal.source")), "left").select(
        "row.*", "size", "__goal.source_size", "__goal.target", F.coalesce(copies, F.lit(0)).cast("int").alias("copies")
    )
