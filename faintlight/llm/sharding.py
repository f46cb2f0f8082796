"""Rendezvous hashing of records over weighted shards (operator 2)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.store import clear_of, written

_SPACE = 1 << 60


def hash60(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by colons, as a long that any SQL engine can compute too."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard with the largest score for the key; a score is -weight / ln(u), u hashed from key and shard.

    A shard that is added takes records only into itself, one that goes gives its records to all others in proportion
    to their weights, and a changed weight moves records only to or from that shard. Equal scores go to the smaller
    shard; shards of weight 0 or less get nothing. A null key is a key like any other.
    """
    shards = sorted(s for s, w in weights.items() if w > 0 and math.isfinite(w))
    if not shards:
        raise ValueError("no shard has a weight above 0")
    scored = [
        F.struct(
            (F.lit(-float(weights[s])) / F.ln((hash60(key, F.lit(s)).cast("double") + 1.0) / float(_SPACE + 2))).alias("score"),
            F.lit(-s).alias("minus_shard"),
        )
        for s in shards
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["minus_shard"]).cast("int")


def with_slots(frame: DataFrame, shard: str, key: str, spread: Column | None = None, slot: str = "slot", per_bucket: int = 50_000) -> DataFrame:
    """Adds `slot`: places 0, 1, 2 ... within each shard without gaps.

    A shard may hold more rows than one task can sort, so rows are counted in buckets of about `per_bucket` rows; a
    bucket's places start where the buckets before it end. Buckets come from `spread`, a long (a hash of all columns
    but maps, unless given), so that rows of one key lie in many buckets; rows that are wholly alike share one. Within a
    bucket rows are in order of the key and then of all their other columns, so places only depend on the rows.

    The frame is read twice, once for the counts, and its rows are shuffled once. Null keys come first; an empty frame
    stays empty. A column `slot` of the frame is replaced; other names of columns don't matter.
    """
    frame = frame.drop(slot)
    rest = [F.col(f"`{c}`") for c, kind in frame.dtypes if c not in (shard, key) and "map<" not in kind]
    spread = F.xxhash64(F.col(key), *rest) if spread is None else spread
    rows = frame.select(F.struct(*(F.col(f"`{c}`") for c in frame.columns)).alias("row"), F.col(shard).alias("shard"), spread.alias("spread"))
    counted = written(rows.groupBy("shard", F.floor(F.col("spread") / (1 << 48)).alias("part")).agg(F.count("*").alias("n")))
    buckets = max(1, math.ceil((counted.agg(F.sum("n")).first()[0] or 0) / per_bucket))
    # Of either sign, and so many at most as there are parts of the range of `spread`.
    bucket = lambda part: F.pmod(part, F.lit(min(buckets, 4096)))
    before = Window.partitionBy("in_shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counted.groupBy(F.col("shard").alias("in_shard"), bucket(F.col("part")).alias("bucket")).agg(F.sum("n").alias("n"))
    offsets = counts.select("in_shard", F.col("bucket").alias("in_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("bucket", bucket(F.floor(F.col("spread") / (1 << 48))))
    order = [F.col("row")[key], *(F.col("row")[c] for c, kind in frame.dtypes if c not in (shard, key) and "map<" not in kind)]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(*order)))
    joined = rows.join(F.broadcast(offsets), F.col("shard").eqNullSafe(F.col("in_shard")) & (F.col("bucket") == F.col("in_bucket")))
    return joined.select("row.*", (F.col("offset") + F.col("place") - 1).cast("long").alias(slot))


def sharded(docs: DataFrame, weights: Mapping[int, float], id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of docs with `shard` (by rendezvous hashing of the id) and `slot` (gapless in each shard).

    Columns of docs that bear these names get `input_` before them. The shard depends on id and
    weights alone: equal ids, null ids among them, go together. An empty table stays empty; repeated rows have slots of
    their own, in no special order among each other; texts of any length, empty or null, only play a part in the order.
    """
    docs = clear_of(docs, ("shard", "slot"))
    return with_slots(docs.withColumn("shard", rendezvous(F.col(id_col), weights)), "shard", id_col)
