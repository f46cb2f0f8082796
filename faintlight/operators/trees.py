"""Random forests whose trees each grow to their full depth on their own rows, while the rows they are asked for stream past.

Spark's random forest keeps all nodes on the driver and passes over the table for every few thousand of them, which deep
trees on many classes have by the million. Here it only grows the top of large forests; each (tree, leaf) of that top is
a unit of rows, which a task takes one after the other, and no node leaves the task that grows it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlight.operators.tables import removed, stored, tidied

#: Rows of a unit: forests of more rows get a top that is deep enough to leave about an eighth of this in a leaf.
WHOLE = 100_000
#: Bytes that the trees of a unit take, at most.
HELD = 1 << 29
#: Rows that trees with a top shuffle at a time, about; one tree's at least.
SHUFFLED = 6_000_000
#: How often a row is drawn for a tree, by chance: up to so many times at these cumulated probabilities (Poisson, mean 1).
DRAWN = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))


def _cumulated(x: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums within groups that stand together; `group` numbers them in their order."""
    total = np.cumsum(x)
    return total - (total[starts] - x[starts])[group]


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys below `most`; 16 bits are sorted by counting, in one pass over the rows."""
    return np.argsort(key.astype(np.uint16) if most <= 1 << 16 else key, kind="stable")


def _split(node: np.ndarray, rank: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, totals: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """(node, score, rank, next rank): for each node the best cut of one feature by the Gini impurity, where there is any.

    Rows that don't come in the order of their rank are put in it first."""
    m, classes = totals.shape
    if (rank[1:] < rank[:-1]).any():
        order = np.argsort(rank, kind="stable")
        node, rank, y, w, n = (a[order] for a in (node, rank, y, w, n))
    order = _order(node, m)
    node, rank, y, w, n = (a[order] for a in (node, rank, y, w, n))
    new = np.concatenate([[True], node[1:] != node[:-1]])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    of_class = node * classes + y
    if m * classes <= 1 << 16:
        by_class = _order(of_class, m * classes)
    else:
        by_class = _order(y, classes)
        by_class = by_class[_order(node[by_class], m)]
    key = of_class[by_class]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    before = np.empty(len(w))  # weight of the row's class in its node left of it
    before[by_class] = _cumulated(w[by_class], np.flatnonzero(first), np.cumsum(first) - 1) - w[by_class]
    left, rows = _cumulated(w, starts, group), _cumulated(n, starts, group)
    squares = _cumulated(2 * w * before + w * w, starts, group)
    across = _cumulated(w * totals.ravel()[of_class], starts, group)
    right = totals.sum(axis=1)[node] - left
    rest = (totals**2).sum(axis=1)[node] - 2 * across + squares
    sizes = np.add.reduceat(n, starts)[group]
    cut = np.concatenate([~new[1:] & (rank[1:] != rank[:-1]), [False]]) & (rows >= leaf) & (sizes - rows >= leaf)
    score = np.where(cut, squares / left + rest / np.where(cut, right, 1.0), -np.inf)
    most = np.maximum.reduceat(score, starts)
    best = np.flatnonzero(cut & (score == most[group]))
    of, at = np.unique(node[best], return_index=True)
    at = best[at]
    return of, score[at], rank[at], rank[at + 1]


class _Tree:
    """A tree grown level by level, all nodes of a level at once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, classes: int, depth: int, leaf: int, rng: np.random.Generator):
        d = x.shape[1]
        values, ranks = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(d)), strict=True)
        ranks = [r.astype(np.int32) for r in ranks]
        ordered = [np.argsort(r, kind="stable").astype(np.int32) for r in ranks]  # open rows by each feature, sorted once
        y = y.astype(np.int32)
        take = math.ceil(math.sqrt(d))
        feature, cut, left = [np.array([-1])], [np.zeros(1)], [np.array([-1])]
        at, count, own = np.zeros(len(x), dtype=np.int32), 1, np.arange(len(x))
        first = 0  # the first node of this level
        for _ in range(depth):
            node, m = at[own] - first, count - first
            totals = np.bincount(node * classes + y[own], w[own], m * classes).reshape(m, classes)
            open_ = ((totals > 0).sum(axis=1) > 1) & (np.bincount(node, n[own], m) >= 2 * leaf)
            own = own[open_[node]]
            if not len(own):
                break
            node = at[own] - first
            place = np.full(len(x), m, dtype=np.int32)  # m: not open
            place[own] = node
            chosen = np.zeros((m + 1, d), dtype=bool)
            np.put_along_axis(chosen[:m], np.argsort(rng.random((m, d)), axis=1)[:, :take], True, axis=1)
            score = (totals**2).sum(axis=1) / np.where(totals.sum(axis=1) > 0, totals.sum(axis=1), 1.0) * (1 + 1e-9)
            of_level, where = np.full(m, -1), np.zeros(m)
            for f in range(d):
                of_row = place[ordered[f]]
                if len(own) < 0.8 * len(of_row):
                    ordered[f], of_row = (a[of_row < m] for a in (ordered[f], of_row))
                looks = chosen[:, f].copy()[of_row]
                asks, of_row = ordered[f][looks], of_row[looks]
                if not len(asks):
                    continue
                of, s, low, high = _split(of_row, ranks[f][asks], y[asks], w[asks], n[asks], totals, leaf)
                better = s > score[of]
                of, low, high = of[better], values[f][low[better]], values[f][high[better]]
                middle = low + (high - low) / 2
                score[of], of_level[of], where[of] = s[better], f, np.where((middle >= low) & (middle < high), middle, low)
            split = np.flatnonzero(of_level >= 0)
            children = np.full(m, -1)
            children[split] = count + 2 * np.arange(len(split))
            feature[-1], cut[-1], left[-1] = of_level, where, children
            own = own[of_level[node] >= 0]
            if not len(own):
                break
            node = at[own] - first
            at[own] = children[node] + ~(x[own, of_level[node]] <= where[node])
            first, count = count, count + 2 * len(split)
            feature.append(np.full(count - first, -1)), cut.append(np.zeros(count - first)), left.append(np.full(count - first, -1))
        self.feature, self.cut, self.left = (np.concatenate(a) for a in (feature, cut, left))
        shares = np.bincount(at * classes + y, w, count * classes).reshape(count, classes)
        self.shares = shares / np.where(shares.sum(axis=1) > 0, shares.sum(axis=1), 1.0)[:, None]

    def asked(self, x: np.ndarray) -> np.ndarray:
        """The shares of the classes in each row's leaf."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.shares[node]
            at = node[inner]
            node[inner] = self.left[at] + ~(x[inner, self.feature[at]] <= self.cut[at])


def _grown(rows: list, unit: tuple[int, int], step: int, classes: int, trees: int, depth: int, leaf: int, seed: int) -> list[_Tree]:
    """The trees of a unit: that of its number, and with every `step` further ones as far as there are."""
    held = [np.concatenate(a) for a in zip(*rows, strict=True)]
    order = np.argsort(held[0], kind="stable")
    x, y, w, copies, chances = (a[order] for a in held[1:])
    many, found = copies > 1, []
    for i, tree in enumerate(range(unit[0], trees, step)):
        n = np.searchsorted(DRAWN, chances[:, i], side="right").astype(float)
        n[many] = np.random.default_rng([seed, tree, unit[1], 1]).poisson(copies[many])
        own = np.flatnonzero(n)
        if len(own):
            found.append(_Tree(x[own], y[own], (w * n)[own], n[own], classes, depth, leaf, np.random.default_rng([seed, tree, unit[1]])))
    return found


def _votes(batches: Iterator[pa.RecordBatch], step: int, classes: int, trees: int, depth: int, leaf: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(id, label, share) of the rows that follow their unit's train rows. A unit's train rows, its trees and a batch are held."""
    unit, rows, grown = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        of, part, asks, ids, y, w, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "leaf", "asks", "id", "y", "w", "copies"))
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
        starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])]))
        for start, end in zip(starts, [*starts[1:], len(of)], strict=True):
            if unit != (int(of[start]), int(part[start])):
                unit, rows, grown = (int(of[start]), int(part[start])), [], []
            if not asks[start]:
                chances = batch.column("chances").slice(start, end - start).flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1)
                rows.append(tuple(a.copy() for a in (ids[start:end], x[start:end], y[start:end], w[start:end], copies[start:end], chances)))
                continue
            if rows:
                rows, grown = [], _grown(rows, unit, step, classes, trees, depth, leaf, seed)
            if grown:
                shares = sum(tree.asked(x[start:end]) for tree in grown)
                row, label = np.nonzero(shares)
                yield pa.RecordBatch.from_arrays([pa.array(ids[start:end][row]), pa.array(label.astype(np.int32)), pa.array(shares[row, label])], names=["id", "label", "share"])


def votes(train: DataFrame, test: DataFrame, classes: int, trees: int, depth: int, leaf: int, seed: int) -> DataFrame:
    """(id, label, share): the mean share of each label (0 to classes - 1) over the leaves that a test row (id, v) comes to.

    Train rows have id, v, y (the label) and w (their weight). Trees draw them by a hash of tree and id (Poisson, mean 1) and
    look at the root of the features at each node. Train rows of a unit are at most WHOLE where there are no more different
    ones in all, and a unit grows several trees on them, so that rows are shuffled for each unit and not for each tree, and
    a test row's shares leave a task summed; else Spark's forest grows a top first, with draws of its own, and its leaves
    are the units, a few trees at a time. In the first case rows equal in all but id are one row, drawn as often as all of them together.
    """
    n = train.count()
    same = train.groupBy("v", "y", "w").agg(F.min("id").alias("id"), F.count("*").alias("copies")).checkpoint()
    different = same.count()
    merged = different <= min(0.9 * n, WHOLE)
    train, n = (same, different) if merged else (train.withColumn("copies", F.lit(1).cast("long")), n)
    parallel = train.sparkSession.sparkContext.defaultParallelism
    total = lambda found: found.groupBy("id", "label").agg(F.sum("share").alias("share"))
    if n > WHOLE:
        summed = _by_turns(train, test, n, classes, trees, depth, leaf, seed, total)
    else:
        groups = min(trees, max(2 * parallel, math.ceil(trees * 16 * n * classes / HELD)))
        met = _units(train, test, list(range(groups)), groups, trees, seed, merged).repartitionById(groups, F.col("group"))
        summed = total(_voted(met, groups, classes, trees, depth, leaf, seed))
    return summed.select("id", "label", F.round(F.col("share") / trees, 9).alias("share"))


def _by_turns(train: DataFrame, test: DataFrame, n: int, classes: int, trees: int, depth: int, leaf: int, seed: int, total: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summed shares of trees whose top Spark's forest grows. Each tree has its own rows in its units, so all trees'
    rows together would be the table many times over: a few trees at a time shuffle theirs and add to the sums so far."""
    spark, top = train.sparkSession, math.ceil(math.log2(n / WHOLE)) + 3
    grower = RandomForestClassifier(numTrees=trees, maxDepth=top, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed, featuresCol="__x", labelCol="y", weightCol="w")
    tops = grower.fit(train.withColumn("__x", array_to_vector("v"))).trees
    step = max(1, min(trees, SHUFFLED // max(1, math.ceil((1 - DRAWN[0]) * n) + test.count())))
    summed, before, paths = None, [], []
    with tidied(spark):
        for first in range(0, trees, step):
            turn = list(range(first, min(first + step, trees)))
            known, asked = (_with_leaves(a, [tops[i] for i in turn]) for a in (train, test))
            tasks = min(len(turn) * 2**top, max(4 * spark.sparkContext.defaultParallelism, math.ceil(n * len(turn) / WHOLE)))
            met = _units(known, asked, turn, trees, trees, seed, False).repartition(tasks, "group", "leaf")
            found = _voted(met, trees, classes, trees, max(depth - top, 1), leaf, seed)
            summed = stored(total(found if summed is None else summed.unionByName(found)), paths)
            removed(spark, before)
            before, paths = paths, []
    return summed


def _with_leaves(rows: DataFrame, tops: list) -> DataFrame:
    """The rows with `leaves`, the leaf of each of these tops that they come to."""
    found = rows.withColumn("__x", array_to_vector("v"))
    for i, tree in enumerate(tops):
        found = tree.setFeaturesCol("__x").setLeafCol(f"__leaf_{i}").setPredictionCol("").setProbabilityCol("").setRawPredictionCol("").transform(found)
    return found.select(*rows.columns, F.array(*(F.col(f"__leaf_{i}").cast("int") for i in range(len(tops)))).alias("leaves"))


def _units(train: DataFrame, test: DataFrame, turn: list[int], groups: int, trees: int, seed: int, merged: bool) -> DataFrame:
    """The rows of both frames in the units of these groups: (group, leaf, asks, id, v, y, w, copies, chances). Without `leaves` a group is one unit."""
    chance = lambda tree: F.pmod(F.xxhash64(tree, "id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chances = F.array(*(chance(F.col("group") + i) for i in range(0, trees, groups)))
    every = lambda rows: rows.select(*rows.columns, F.posexplode(F.lit(turn).cast("array<int>")).alias("__at", "group"))
    unit = lambda rows: (F.get("leaves", F.col("__at")) if "leaves" in rows.columns else F.lit(0)).alias("leaf")
    known, asks = every(train).withColumn("chances", chances), every(test)
    known = known.where(F.col("chances")[0] >= DRAWN[0]) if groups == trees and not merged else known
    known = known.select("group", unit(known), F.lit(False).alias("asks"), "id", "v", F.col("y").cast("int").alias("y"), "w", "copies", "chances")
    blank = {"y": F.lit(0), "w": F.lit(0.0), "copies": F.lit(0).cast("long"), "chances": F.array().cast("array<double>")}
    return known.unionByName(asks.select("group", unit(asks), F.lit(True).alias("asks"), "id", "v", *(c.alias(k) for k, c in blank.items())))


def _voted(met: DataFrame, groups: int, classes: int, trees: int, depth: int, leaf: int, seed: int) -> DataFrame:
    votes_of = partial(_votes, step=groups, classes=classes, trees=trees, depth=depth, leaf=leaf, seed=seed)
    return met.sortWithinPartitions("group", "leaf", "asks").mapInArrow(votes_of, "id long, label int, share double")
