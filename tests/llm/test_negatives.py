"""Hard negatives against brute force, and on awkward input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintlight.llm import negatives


def whole(v, steps=256):
    scaled = [None if x is None else x * float(steps) for x in v] if v is not None else [None]
    if any(x is None or not math.isfinite(x) for x in scaled):
        return None
    return [math.floor(x) for x in scaled]


def brute(rows, is_anchor, k_positives=5, k=5, least=80):
    known = {}
    for i, v, label in sorted((r for r in rows if None not in (r[0], r[2]) and whole(r[1]) is not None), key=lambda r: (r[2], whole(r[1]))):
        known.setdefault(i, (whole(v), label))
    out = set()
    for a, (v, label) in known.items():
        if not is_anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (w, other) in known.items() if i != a and len(w) == len(v)]
        scored = sorted((-s, i, other) for s, i, other in scored if -(1 << 63) <= s < 1 << 63)
        for p, pid, _ in [x for x in scored if x[2] == label][:k_positives]:
            inside = [(i, -s) for s, i, other in scored if other != label and least * -p <= 100 * -s <= 100 * -p]
            out |= {(a, pid, rank, i, -p, s) for rank, (i, s) in enumerate(inside[:k], 1)}
    return out


def mined(spark, rows, anchor=3, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").withColumn("score", F.lit("clash")).withColumn("v", F.lit(0)).withColumn("query", F.lit(0))
    got = negatives.hard_negatives(frame.repartition(3), F.col("vec_id") % anchor == 0, **more).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "QUERY_BLOCK", 8)
    monkeypatch.setattr(negatives, "DEPTH", 1)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 6))
    rows = [(i, (centres[rng.integers(3)] + 0.3 * rng.normal(size=6)).tolist(), int(rng.integers(4))) for i in range(150)]
    rows += [(200 + i, rows[3][1], rows[3][2] if i % 3 else 9) for i in range(40)]  # a vector that many rows have
    rows += [(300 + i, [0.0] * 6, i % 2) for i in range(8)]
    want = brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, rows) == want and len(want) > 500


def test_hard_negatives_of_few_and_odd_rows(spark):
    big, huge = 1e10, 3e38
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.9, 0.9], 2), (3, [big, 0.0], 1), (4, [big, 0.0], 2), (5, [huge, 0.0], 1), (6, [0.0, 1.0], 2),
        (7, None, 1), (8, [None, 1.0], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 2), (11, [1.0, 1.0], None),
        (12, [1.0], 1), (15, [1.0], 1), (13, [1.0], 2), (18, [], 1), (19, [], 2), (20, [], 1), (21, [-1.0, -1.0], 3), (22, [-1.0, -1.0], 3),
        (24, [1.0, 1.0], 5), (24, [1.0, 0.0], 4), (24, [0.5, 0.0], 4), (0, [1.0, 1.0], 1),
    ]
    want = brute(rows, lambda i: i % 3 == 0)
    assert mined(spark, rows) == want
    assert any(r[0] == 3 for r in want) and any(r[0] == 18 for r in want) and any(r[3] == 4 for r in want)
    assert mined(spark, []) == set()


@pytest.mark.parametrize(("score", "limit"), [(10, 8), (11, 9), (0, 0), (-10, -8), (1, 1), (2**62, -(-80 * 2**62 // 100))])
def test_lower_limit_is_exact(score, limit):
    assert negatives.lower_limit(score, 80) == limit


def test_the_search_ends_before_it_has_read_all():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * rng.normal(size=(2000, 4)))
    vectors[:20] *= 8
    block = negatives.Block(np.arange(2000), np.zeros(2000, dtype=np.int64), vectors)
    met = 0
    ids, kept = negatives.first_of_label(block, vectors[0], 0, 3)
    for new, _, threshold in negatives.accessed(block, vectors[0]):
        met += len(new)
        if threshold < int(kept[-1]):
            break
    scores = (vectors @ vectors[0]).astype(int)
    assert ids.tolist() == np.lexsort((np.arange(2000), -scores))[:3].tolist() and met < 1900
