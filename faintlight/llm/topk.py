"""Exact top-k search by Fagin's threshold algorithm (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.negatives import Block, accessed, whole_numbers
from faintlight.llm.store import written

BLOCK = 8192
QUERY_BLOCK = 512
LEAST = -(1 << 63)


def threshold_search(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floors: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best ids of the rows but its own: (query id, ids, scores), by the threshold algorithm.

    Every dimension has a list of the rows in order of their component. All lists are read from their better end, a
    few places at a time; rows that come up are scored in full. No row that has not come up can score more than the
    query times the components next in line; once the kth score is above that bound, the search ends. It also ends, and
    may not even begin, where the bound is below the query's floor: scores under the floor aren't wanted.
    """
    block = Block(ids, ids, rows.astype(float))
    floors = np.full(len(queries), LEAST) if floors is None else floors
    for q, own, floor in zip(queries.astype(float), query_ids.tolist(), floors.tolist(), strict=True):
        best, kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for new, scores, bound in accessed(block, q):
            wanted = (ids[new] != own) & (scores >= floor)
            if wanted.any():
                best, kept = np.concatenate([best, new[wanted]]), np.concatenate([kept, scores[wanted]])
                order = np.lexsort((ids[best], ~kept))  # ~ turns the order round and can't overflow
                order = order[np.sort(np.unique(ids[best[order]], return_index=True)[1])[:k]]  # each id's best vector
                best, kept = best[order], kept[order]
            if bound is not None and (bound < floor or len(kept) == k and bound < int(kept[-1])):
                break
        yield own, ids[best], kept


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            dims = batch.column("dims")[i].as_py()
            ids, query_ids = part("ids"), part("query_ids")
            found = list(
                threshold_search(part("queries").reshape(len(query_ids), dims), query_ids, part("rows").reshape(len(ids), dims), ids, k, part("floors"))
            )
            sizes = [len(ids) for _, ids, _ in found]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([q for q, _, _ in found], sizes)),
                        pa.array(np.concatenate([x for _, x, _ in found])),
                        pa.array(np.concatenate([x for _, _, x in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, steps: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k rows with the largest inner product for each query: (query_id, rank, vec_id, score).

    Components are floor(steps * x). Candidates are all rows with another id and as many components; ties go to the
    smaller id; fewer candidates give fewer rows. Vectors that are null or hold null, NaN or infinite components, and rows
    without an id, take no part. Components may have any size: scores are exact integers, and a pair whose score doesn't fit
    a long is left out. A row repeated as a whole counts once; an id with several vectors is several candidates and several
    queries, whose results merge. Other columns are ignored.

    Of identical vectors only the k + 1 smallest ids can be among anybody's k best others, so copies go first. The
    rest is cut into blocks of bounded size by length, the longest vectors last. Every query first searches the block of
    the longest, where high scores are likeliest; its kth score there is its floor. All other blocks are searched by the
    threshold algorithm against that floor, but for those whose longest vector is too short for any floor of a block of
    queries (a score is at most the product of both lengths); these pairs of blocks are never brought together.
    """
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = (
        vectors.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), steps).alias("v"), is_query.alias("is_query"))
        .where("v IS NOT NULL")
        .dropDuplicates(["vec_id", "v"])
        .select("vec_id", "v", "is_query", F.size("v").alias("dims"), F.sqrt(squares).alias("length"))
    )
    rows = written(rows)
    queries = rows.where("is_query").withColumn("floor", F.lit(LEAST))
    n_blocks = max(1, math.ceil(rows.count() / BLOCK))
    n_query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    copies = Window.partitionBy("v").orderBy("vec_id")
    candidates = rows.withColumn("__copy", F.row_number().over(copies)).where(F.col("__copy") <= k + 1).select("vec_id", "v", "dims", "length")
    candidates = written(candidates.repartitionByRange(n_blocks, "dims", "length", "vec_id").withColumn("block", F.spark_partition_id()))

    def searched(rows: DataFrame, queries: DataFrame) -> DataFrame:
        blocks = rows.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("both"))
        blocks = blocks.select("dims", "block", F.col("both.vec_id").alias("ids"), F.flatten("both.v").alias("rows"))
        placed = queries.withColumn("query_block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_query_blocks)).cast("int"))
        query_blocks = placed.groupBy("dims", "query_block").agg(F.collect_list(F.struct("vec_id", "v", "floor")).alias("both"))
        query_blocks = query_blocks.select(
            "dims", "query_block", F.col("both.vec_id").alias("query_ids"), F.flatten("both.v").alias("queries"), F.col("both.floor").alias("floors")
        )
        # The length that a vector needs at least to reach a query's floor; rounding is given room.
        need = F.when((F.col("length") > 0) & (F.col("floor") > 0), F.col("floor") / F.col("length") * (1 - 1e-9)).otherwise(0.0)
        needs = placed.groupBy("dims", "query_block").agg(F.min(need).alias("need"))
        reach = rows.groupBy("dims", "block").agg(F.max("length").alias("reach"))
        live = reach.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).join(needs, ["dims", "query_block"])
        live = live.where("reach >= need").select("dims", "block", "query_block")
        pairs = blocks.join(live, ["dims", "block"]).join(query_blocks, ["dims", "query_block"])
        pairs = pairs.repartition(n_blocks * n_query_blocks, "block", "query_block").select("dims", "ids", "rows", "query_ids", "queries", "floors")
        return pairs.mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)

    if n_blocks == 1:
        return best(searched(candidates, queries)).select("query_id", "rank", "vec_id", "score")
    longest = candidates.groupBy("dims").agg(F.max("block").alias("block"))
    first = written(best(searched(candidates.join(longest, ["dims", "block"], "left_semi"), queries)))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    queries = queries.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST)))
    others = searched(candidates.join(longest, ["dims", "block"], "left_anti"), queries)
    return best(first.drop("rank").unionByName(others)).select("query_id", "rank", "vec_id", "score")
