"""Whitening against brute force, and on awkward input."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from faintlight.llm import queries, whitening


def determinant(m):
    m, sign = [[Fraction(x) for x in row] for row in m], 1
    for k in range(len(m)):
        i = next((i for i in range(k, len(m)) if m[i][k]), None)
        if i is None:
            return 0
        if i != k:
            m[i], m[k], sign = m[k], m[i], -sign
        for r in range(k + 1, len(m)):
            f = m[r][k] / m[k][k]
            m[r] = [a - f * b for a, b in zip(m[r], m[k], strict=True)]
    for k in range(len(m)):
        sign *= m[k][k]
    return sign


def scatter(rng, d, n, size):
    b = [[rng.randint(-size, size) for _ in range(d)] for _ in range(n)]
    return [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize(("d", "n", "size"), [(1, 2, 5), (3, 2, 10), (6, 9, 10**6), (7, 3, 10**12), (5, 0, 1)])
def test_polynomial_is_exact(spark, d, n, size):
    m = scatter(random.Random(d), d, n, size)
    p = whitening.characteristic_polynomial(spark, m)
    for x in range(-3, d):
        assert sum(c * x**i for i, c in enumerate(p)) == determinant([[x * (i == j) - v for j, v in enumerate(row)] for i, row in enumerate(m)])


def times(p, q):
    out = [0] * (len(p) + len(q) - 1)
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            out[i + j] += a * b
    return out


def test_roots_are_isolated_whatever_their_distance():
    p = [1]
    for r in (0, 0, 3, 3, 3, 5, 10**15, 10**15 + 1, 10**30):
        p = times(p, [-r, 1])
    got = [(Fraction(root, 1 << bits), n) for root, bits, n in whitening.largest_roots(p, 99)]
    assert got == [(10**30, 1), (10**15 + 1, 1), (10**15, 1), (5, 1), (3, 3), (0, 2)]
    p = times([1, -3, 1], [2, -4, 1])  # irrational roots
    got = [root / (1 << bits) for root, bits, _ in whitening.largest_roots(p, 9)]
    assert got == pytest.approx(sorted([(3 + 5**0.5) / 2, (3 - 5**0.5) / 2, 2 + 2**0.5, 2 - 2**0.5], reverse=True), rel=1e-15)


def frame(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("whitened", F.lit(1))


def check(rows, vectors, k=32):
    """All that the contract says about the rows for these vectors, by exact sums and numpy."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors.values()]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[float(Fraction(v * n - s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    cov = centred.T @ centred / n
    e = np.linalg.eigvalsh(cov)[::-1][: min(k, d)]
    exact = {i: sum((v * n - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in zip(vectors, x, strict=True)}
    w = {}
    for r in rows:
        assert r["n"] == n and int(r["deviation"]) == exact[r["vec_id"]]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(cov), rel=1e-4, abs=1e-12)
        w.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    assert len(rows) == n * len(e) and {len(v) for v in w.values()} == {len(e)}
    live = [i + 1 for i in range(len(e)) if w[next(iter(w))][i + 1] is not None]
    table = np.array([[w[i][c] for c in live] for i in vectors])
    assert np.abs(table.T @ table / n - np.eye(len(live))).max() < 1e-6
    assert max(r["identity_error"] for r in rows) < 1e-6
    # whitened values are those of eigenvectors: what they give back of the vectors is in proportion to e
    back = centred.T @ table / n
    assert np.allclose(cov @ back, back * e[: len(live)], rtol=1e-6, atol=1e-6 * e[0])
    return len(live)


def test_whitened_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6)) * [5, 3, 3, 1, 0.1, 0.0]
    vectors = {i: v.tolist() for i, v in enumerate(base @ np.linalg.qr(rng.normal(size=(6, 6)))[0])}
    rows = whitening.whitened(frame(spark, list(vectors.items())).repartition(5), k=4).collect()
    assert check(rows, vectors, 4) == 4


def test_whitening_takes_far_entries_equal_eigenvalues_and_few_rows(spark):
    far = {0: [1e9, 0.0, 1.0], 1: [-1e9, 3.0, 2.0], 2: [5.0, 1e5, -1.0], 3: [7.0, 2.0, 0.0], 4: [1.0, 2.0, 1e9]}
    rows = whitening.whitened(frame(spark, list(far.items()))).collect()
    n, sums = 5, [sum(int(np.floor(64 * v[j])) for v in far.values()) for j in range(3)]
    assert {(r["vec_id"], int(r["deviation"])) for r in rows} == {(i, sum((int(np.floor(64 * c)) * n - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in far.items()}
    assert max(r["identity_error"] for r in rows) < 1e-6
    square = {0: [1.0, 1.0], 1: [-1.0, 1.0], 2: [1.0, -1.0], 3: [-1.0, -1.0]}
    assert check(whitening.whitened(frame(spark, list(square.items()))).collect(), square) == 2
    few = {0: [1.0, 2.0, 3.0, 5.0], 1: [2.0, 2.0, 0.0, 1.0], 2: [0.0, 1.0, 1.0, 1.0]}
    assert check(whitening.whitened(frame(spark, list(few.items()))).collect(), few) == 2


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(9, None), (9, [None, 1.0]), (9, [nan, 1.0]), (9, [inf, 1.0]), (9, [1e30, 1.0]), (9, [1.0]), (9, [])]
    rows = whitening.whitened(frame(spark, [*odd, (1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 0.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in rows) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows)
    assert sorted(round(r["whitened"] ** 2, 9) for r in rows if r["component"] == 1) == [0.5, 0.5, 2.0]
    one = whitening.whitened(frame(spark, [(3, [1.0, 2.0])])).collect()
    assert [(r["component"], r["whitened"], r["explained"], int(r["deviation"]), r["identity_error"]) for r in one] == [(1, None, None, 0, None), (2, None, None, 0, None)]
    assert whitening.whitened(frame(spark, [])).collect() == [] == whitening.whitened(frame(spark, odd[:5])).collect()


def test_whitening_query(spark):
    path = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    assert check(queries.op12_whitening(spark, path).collect(), vectors) == 32
