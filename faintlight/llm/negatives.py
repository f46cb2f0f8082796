"""Hard-negative mining by Fagin's threshold algorithm (operator 11)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.store import written

#: Candidates whose sorted lists are searched together, queries that meet them at a time, places read at first.
BLOCK = 2048
QUERY_BLOCK = 512
DEPTH = 64

_BLOCKS = "dims int, block long, first_label long, last_label long, ids binary, labels binary, vectors binary, lists binary"
_QUERIES = "dims int, query_block long, first_label long, last_label long, query_ids binary, query_labels binary, queries binary, windows array<array<long>>"
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def whole_numbers(vector: Column, steps: int) -> Column:
    """floor(steps * x) of each component x as a double, which holds it exactly whatever its size.

    Null where the vector or a component is null, NaN or infinite, or is so once multiplied."""
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * F.lit(float(steps)))
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    return F.when(sound, whole)


class Block:
    """Candidates with a list of their places for every dimension, in order of the component; scores are exact integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, lists: np.ndarray | None = None):
        self.ids, self.labels = ids, labels
        self.lists = np.argsort(vectors, axis=0, kind="stable") if lists is None else lists
        self.most = float(np.abs(vectors).max()) if vectors.size else 0.0
        self.forms = {"float": vectors}

    def form(self, q: np.ndarray) -> str:
        """How inner products with q stay exact: sums of products below 2^53 as doubles, below 2^62 as longs, else as Python's integers."""
        largest = self.most * float(np.abs(q).sum())
        return "float" if largest < 1 << 53 else "long" if largest < 1 << 62 else "object"

    def vectors(self, form: str) -> np.ndarray:
        if form not in self.forms:
            self.forms[form] = in_form(self.forms["float"], form)
        return self.forms[form]


def in_form(values: np.ndarray, form: str) -> np.ndarray:
    if form == "object":
        return np.frompyfunc(int, 1, 1)(values).astype(object)
    return values.astype(np.int64) if form == "long" else values


def accessed(block: Block, vector: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """(places, scores, threshold): rows as sorted access meets them, with their full scores by random access.

    Each dimension's list is read from the end where its product with the anchor's component is larger; dimensions
    where that component is 0 aren't read. No row that has not been met scores above the threshold, which is None once
    all rows have been. The first item holds no rows, so a search may end before it reads any. Scores that don't fit a
    long are left out.
    """
    form = block.form(vector)
    rows, q, n = block.vectors(form), in_form(vector, form), len(block.ids)
    used = np.flatnonzero(vector)
    down, part = vector[used] > 0, q[used]

    def threshold(depth: int) -> int | None:
        if depth >= n:
            return None
        return int((part * rows[block.lists[np.where(down, n - 1 - depth, depth), used], used]).sum())

    seen = np.zeros(n, dtype=bool)
    depth, step = 0, DEPTH
    yield np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), threshold(0)
    while depth < n:
        end = min(n, depth + step) if len(used) else n
        if end == n:
            new = np.flatnonzero(~seen)
        else:
            places = np.arange(depth, end)[:, None]
            met = np.zeros(n, dtype=bool)
            met[block.lists[np.where(down, n - 1 - places, places), used].ravel()] = True
            new = np.flatnonzero(met & ~seen)
        seen[new] = True
        scores = rows[new] @ q if len(new) and len(q) else np.zeros(len(new))
        if form == "object" and len(new):
            fits = np.array([_LEAST <= s <= _MOST for s in scores])
            new, scores = new[fits], scores[fits]
        depth, step = end, step * 2
        yield new, scores.astype(np.int64), threshold(depth)


def _best(block: Block, places: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((block.ids[places], ~scores))[:k]  # ~ turns the order round and can't overflow
    return places[order], scores[order]


def first_of_label(block: Block, vector: np.ndarray, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of the label: (ids, scores)."""
    best, kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for new, scores, threshold in accessed(block, vector):
        own = block.labels[new] == label
        if own.any():
            best, kept = _best(block, np.concatenate([best, new[own]]), np.concatenate([kept, scores[own]]), k)
        if threshold is not None and len(kept) == k and threshold < int(kept[-1]):
            break
    return block.ids[best], kept


def lower_limit(score: int, least: int) -> int:
    """The smallest integer s with 100 * s >= least * score."""
    return -(-least * score // 100)


def first_in_windows(block: Block, vector: np.ndarray, label: int, tops: list[int], k: int, least: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each window, from `least` per cent of its top to its top, the k best rows of other labels: (top, ids, scores).

    All windows share one search. It ends once the threshold is below the kth score of each window that is full, and
    below the lower limit of the others.
    """
    none = np.zeros(0, dtype=np.int64)
    windows = {top: (none, none) for top in tops if lower_limit(top, least) <= top}
    for new, scores, threshold in accessed(block, vector) if windows else ():
        other = block.labels[new] != label
        new, scores = new[other], scores[other]
        for top, (best, kept) in windows.items():
            inside = (scores <= top) & (scores >= lower_limit(top, least))
            if inside.any():
                windows[top] = _best(block, np.concatenate([best, new[inside]]), np.concatenate([kept, scores[inside]]), k)
        if threshold is not None and all(
            threshold < (int(kept[-1]) if len(kept) == k else lower_limit(top, least)) for top, (_, kept) in windows.items()
        ):
            break
    return [(top, block.ids[best], kept) for top, (best, kept) in windows.items()]


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, pa.Table, np.ndarray]]:
    """A partition's rows in pieces of at most `size` rows with as many components: (dims, number, rows, vectors)."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table, number = pa.Table.from_batches(batches), TaskContext.get().partitionId() << 20
    dims = table.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        own = table.filter(pa.array(dims == d))
        for start in range(0, len(own), size):
            part = own.slice(start, size).combine_chunks()
            v = part.column("v").combine_chunks()
            yield d, number, part, v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), d)
            number += 1


def _with_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for d, number, part, v in _parts(batches, BLOCK):
        ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
        lists = np.argsort(v, axis=0, kind="stable").astype(np.int32)
        values = [d, number, labels.min(), labels.max(), ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), v.tobytes(), lists.tobytes()]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names = [x.split()[0] for x in _BLOCKS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(values, types, strict=True)], names=names)


def _in_query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for d, number, part, v in _parts(batches, QUERY_BLOCK):
        ids, labels = part.column("query").to_numpy(), part.column("label").to_numpy()
        values = [d, number, labels.min(), labels.max(), ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), v.tobytes(), part.column("windows").to_pylist()]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.list_(pa.int64()))]
        names = [x.split()[0] for x in _QUERIES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(values, types, strict=True)], names=names)


def _met(pair: pa.Table) -> Iterator[tuple[Block, int, int, np.ndarray, list[int]]]:
    """(candidates, query, its label, its vector, its windows) for each query of each pair of blocks."""
    for r in pair.to_pylist():
        longs = lambda name: np.frombuffer(r[name], dtype=np.int64)  # noqa: B023, E731
        n, d = len(longs("ids")), r["dims"]
        block = Block(longs("ids"), longs("labels"), np.frombuffer(r["vectors"]).reshape(n, d), np.frombuffer(r["lists"], dtype=np.int32).reshape(n, d))
        queries = np.frombuffer(r["queries"]).reshape(len(longs("query_ids")), d)
        yield from ((block, *x) for x in zip(longs("query_ids").tolist(), longs("query_labels").tolist(), queries, r["windows"], strict=True))


def _found(names: list[str], rows: list[tuple]) -> pa.Table:
    """A table of longs from (value, ..., ids, scores), one row for each id."""
    sizes = [len(r[-1]) for r in rows]
    heads = [np.repeat(np.array([r[i] for r in rows], dtype=np.int64), sizes) for i in range(len(names) - 2)]
    tails = [np.concatenate([np.zeros(0, dtype=np.int64), *(r[i] for r in rows)]) for i in (-2, -1)]
    return pa.table(dict(zip(names, [*heads, *tails], strict=True)))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, k_positives: int = 5, k: int = 5, least: int = 80, steps: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): rows near an anchor that have another label.

    A score is the inner product of two vectors of floor(steps * x); higher scores come first, ties by smaller id. An
    anchor's positives are its first `k_positives` other rows of its label. The negatives of anchor and positive are the
    first k rows of other labels that score from `least` per cent of the positive's score to all of it; a positive below
    0 has none. Fewer rows give fewer results.

    Rows without id or label, and vectors that are null or hold null, NaN or infinite components, take no part; of rows
    that share an id, the first by label and vector does. Vectors meet those of as many components, empty ones each
    other. Components may have any size: scores are exact integers, and a pair whose score does not fit a long takes no
    part. Other columns are ignored; an empty table gives an empty result.

    Candidates lie in blocks of bounded size, in order of label, and every block keeps its sorted lists. Equal vectors of
    one label are searched for once, whatever the number of anchors that have them, and of equal candidates only as many
    smallest ids as anybody's lists can hold take part. A first search, over blocks that hold the anchor's label, finds
    the positives; their scores are the windows of the second, over blocks that hold others.
    """
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        whole_numbers(F.col(vector_col), steps).alias("v"), is_anchor.alias("is_anchor"),
    )
    source = source.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = source.groupBy("vec_id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("x")).select("vec_id", "x.*")
    rows = written(rows.withColumn("dims", F.size("v")))
    most = max(k_positives + 1, k)
    equal = Window.partitionBy("label", "v").orderBy("vec_id")
    candidates = rows.withColumn("nth", F.row_number().over(equal)).where(F.col("nth") <= most).drop("nth", "is_anchor")
    candidates = candidates.repartitionByRange(max(1, math.ceil(rows.count() / BLOCK)), "dims", "label", "vec_id")
    blocks = written(candidates.mapInArrow(_with_lists, _BLOCKS))

    anchors = rows.where("is_anchor")
    queries = written(anchors.groupBy("dims", "label", "v").agg(F.min("vec_id").alias("query")))
    members = anchors.join(queries, ["dims", "label", "v"]).select(F.col("vec_id").alias("anchor_id"), "query")
    n_query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def pairs(queries: DataFrame, live: Column):
        packed = queries.repartitionByRange(n_query_blocks, "dims", "label", "query").mapInArrow(_in_query_blocks, _QUERIES)
        packed = written(packed)
        names = packed.select("query_block", "dims", F.col("first_label").alias("q_first"), F.col("last_label").alias("q_last"))
        met = blocks.select("block", "dims", "first_label", "last_label").join(names, "dims").where(live).select("block", "query_block")
        both = blocks.drop("first_label", "last_label").join(met, "block").join(packed.drop("dims", "first_label", "last_label"), "query_block")
        return both.groupBy("block", "query_block")

    def positives(pair: pa.Table) -> pa.Table:
        return _found(["query", "vec_id", "score"], [(query, *first_of_label(block, v, label, k_positives + 1)) for block, query, label, v, _ in _met(pair)])

    def negatives(pair: pa.Table) -> pa.Table:
        found = [(query, *x) for block, query, label, v, tops in _met(pair) for x in first_in_windows(block, v, label, tops, k, least)]
        return _found(["query", "positive_score", "vec_id", "score"], found)

    def first(found: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn(name, F.row_number().over(order).cast("int")).where(F.col(name) <= n)

    same = (F.col("first_label") <= F.col("q_last")) & (F.col("q_first") <= F.col("last_label"))
    bare = queries.withColumn("windows", F.array().cast("array<long>"))
    near = pairs(bare, same).applyInArrow(positives, "query long, vec_id long, score long")
    near = written(first(near, ["query"], k_positives + 1, "nth").drop("nth"))

    one = (F.col("first_label") == F.col("last_label")) & (F.col("q_first") == F.col("q_last")) & (F.col("first_label") == F.col("q_first"))
    asked = queries.join(near.groupBy("query").agg(F.sort_array(F.collect_set("score")).alias("windows")), "query")
    far = pairs(asked, ~one).applyInArrow(negatives, "query long, positive_score long, vec_id long, score long")
    far = written(first(far, ["query", "positive_score"], k, "rank"))

    chosen = members.join(near, "query").where("vec_id <> anchor_id")
    chosen = first(chosen, ["anchor_id"], k_positives, "nth").select("anchor_id", "query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(far, ["query", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
