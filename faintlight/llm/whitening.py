"""Whitening of embeddings with an exact characteristic polynomial (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faintlight.llm.store import written

#: Bits of a root below the trace, digits of the arithmetic in which components are found, steps of inverse iteration.
ROOT_BITS, DIGITS, STEPS = 160, 90, 3
LIMB = 20
#: Rows with an entry further from the mean than this are projected in exact integers.
FAR = 1 << 26
SCALE = 200


def entries(vector, steps: int, shift: int):
    """floor(steps * c) + shift of each entry c as longs; null where the vector or an entry is null, NaN or infinite, or
    an entry's number is beyond 2^61."""
    scaled = F.transform(vector.cast("array<double>"), lambda c: c * F.lit(float(steps)))
    sound = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 61)))
    return F.when(sound, F.transform(scaled, lambda c: F.floor(c) + F.lit(shift)))


# ---- exact sums over all rows


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _emitted(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(shift, i, j, s) for each entry that isn't 0; 2^shift * s adds up to the entry (i, j)."""
    for shift, total in sums.items():
        i, j = np.nonzero(total)
        values = [Decimal(int(x)) for x in total[i, j]]
        if values:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), shift, dtype=np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(values, type=pa.decimal128(38, 0))],
                names=["shift", "i", "j", "s"],
            )


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, "x")
            for shift, part in ((0, x & 0xFFFFFFFF), (32, x >> 32)):
                sums[shift] = sums.get(shift, 0) + part.sum(axis=0)[None, :].astype(object)
    yield from _emitted(sums)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Integers as numbers below 2^LIMB, the last of either sign, so that products of 4,096 rows sum exactly as doubles."""
    out = []
    while np.abs(y).max(initial=0) >= 1 << LIMB:
        out.append(y & ((1 << LIMB) - 1))
        y = y >> LIMB
    return [*out, y]


def _products(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            parts = [p.astype(float) for p in limbs(_matrix(batch.slice(start, 4096), "x") - centre)]
            for a, p in enumerate(parts):
                for b, q in enumerate(parts):
                    shift = LIMB * (a + b)
                    sums[shift] = sums.get(shift, 0) + (p.T @ q).astype(np.int64).astype(object)
    yield from _emitted({shift: np.triu(total) for shift, total in sums.items()})


def _added(rows: DataFrame, function, shape: tuple[int, int]) -> list[list[int]]:
    """The sums of all partitions, as Python's integers: as many numbers as the matrix has, whatever the rows."""
    sums = rows.mapInArrow(function, "shift int, i int, j int, s decimal(38,0)").groupBy("shift", "i", "j").agg(F.sum("s").alias("s"))
    out = [[0] * shape[1] for _ in range(shape[0])]
    for r in sums.collect():
        out[r["i"]][r["j"]] += int(r["s"]) << r["shift"]
    return out


# ---- the characteristic polynomial


def primes_below(limit: int, n: int) -> list[int]:
    """The n largest primes below the limit (below 2^31), by the test of Miller and Rabin."""

    def prime(x: int) -> bool:
        d, r = x - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7):  # enough below 3,215,031,751
            y = pow(a, d, x)
            if a % x and y not in (1, x - 1) and all((y := y * y % x) != x - 1 for _ in range(r - 1)):
                return False
        return True

    found, x = [], limit - 1 - limit % 2
    while len(found) < n:
        if prime(x):
            found.append(x)
        x -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients, from x^0 on, of the characteristic polynomial modulo the prime p: similarity steps bring the matrix
    to Hessenberg form, whose leading minors follow from each other."""
    h, d = matrix.copy() % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        if i != k + 1:
            h[[i, k + 1]] = h[[k + 1, i]]
            h[:, [i, k + 1]] = h[:, [k + 1, i]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), dtype=np.int64)
    minors[0, 0] = 1
    for k in range(d):
        weights, product = np.zeros(k + 1, dtype=np.int64), 1
        for i in range(k, -1, -1):
            weights[i] = int(h[i, k]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        minors[k + 1, 1:] = minors[k, :-1]
        minors[k + 1] = (minors[k + 1] - (weights[:, None] * minors[: k + 1] % p).sum(axis=0)) % p
    return minors[d].tolist()


def _residues(frames: Iterator[pd.DataFrame], matrix: list[list[int]]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [polynomial_modulo(np.array([[x % p for x in row] for row in matrix], dtype=np.int64), p) for p in frame["p"].tolist()]
        yield pd.DataFrame({"p": frame["p"], "residues": rows})


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from x^0 on, of det(x - matrix) for a symmetric matrix of integers without negative eigenvalue.

    Each task takes primes; what the polynomial is modulo all of them is put together by Chinese remainders. The
    coefficients are symmetric functions of the eigenvalues, which the trace bounds, so the number of primes follows
    from the trace.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [0] * d + [1]
    bits = max(math.log2(math.comb(d, k)) + k * (math.log2(trace) - math.log2(d)) for k in range(d + 1))
    primes = primes_below(1 << 31, math.ceil((max(bits, 1) + 8) / 30.9))
    tasks = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 4 * spark.sparkContext.defaultParallelism))
    found = tasks.mapInPandas(partial(_residues, matrix=matrix), "p long, residues array<long>").collect()
    whole, product = [0] * (d + 1), 1
    for r in found:
        inverse = pow(product, -1, r["p"])
        whole = [x + product * ((y - x) * inverse % r["p"]) for x, y in zip(whole, r["residues"], strict=True)]
        product *= r["p"]
    return [x - product if 2 * x > product else x for x in whole]


# ---- its roots


def shifted(polynomial: list[int], a: int) -> list[int]:
    """The coefficients of p(x + a)."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    return c


def roots_above(polynomial: list[int], a: int) -> int:
    """How many roots are above a, for a polynomial all of whose roots are real: the changes of sign in p(x + a)."""
    signs = [c > 0 for c in shifted(polynomial, a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(polynomial: list[int], a: int) -> int:
    value = 0
    for c in reversed(polynomial):
        value = value * a + c
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], k: int, bits: int = ROOT_BITS) -> list[tuple[int, int, int]]:
    """The k largest roots, all roots being real and none negative: (root, bits, times), the root being root / 2^bits.

    Intervals are halved until they hold one root, by the exact count of roots above a number (Descartes), and then by
    the sign. An interval that still holds several at the last bit is one root as many times.
    """
    zeros = next(i for i, c in enumerate(polynomial) if c)
    p, d = polynomial[zeros:], len(polynomial) - 1 - zeros
    found: list[tuple[int, int, int]] = []
    if d:
        trace = -p[-2]
        bits = max(0, bits - trace.bit_length())
        p = [c << bits * (d - i) for i, c in enumerate(p)]
        stack = [(0, trace << bits, d, 0)]  # roots in (low, high], and how many are above both
        while stack and sum(t for _, _, t in found) < k:
            low, high, above_low, above_high = stack.pop()
            n = above_low - above_high
            if n == 0:
                continue
            if n == 1:
                right = 1 if above_high % 2 == 0 else -1  # the sign beyond the root
                while high - low > 1:
                    mid = (low + high) // 2
                    sign = _sign(p, mid)
                    low, high = (mid, high) if sign == -right else (low, mid) if sign else (mid - 1, mid)
            if high - low <= 1:
                found.append((high, bits, n))
                continue
            mid = (low + high) // 2
            above = roots_above(p, mid)
            stack += [(low, mid, above_low, above), (mid, high, above, above_high)]
    if zeros:
        found.append((0, bits, zeros))
    return found


# ---- components


def _null_space(matrix: np.ndarray, root: Decimal, times: int) -> list[np.ndarray]:
    """As many orthonormal vectors as the eigenvalue has, by inverse iteration: one elimination, then a few solutions."""
    d, tiny = len(matrix), Decimal(10) ** -(DIGITS - 10)
    m, order = matrix.copy(), np.arange(d)
    m[np.arange(d), np.arange(d)] -= root
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        if pivot != k:
            m[[k, pivot]] = m[[pivot, k]]
            order[[k, pivot]] = order[[pivot, k]]
        if abs(m[k, k]) < tiny:
            m[k, k] = tiny
        m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
        if k + 1 < d:
            m[k + 1 :, k + 1 :] = m[k + 1 :, k + 1 :] - np.outer(m[k + 1 :, k], m[k, k + 1 :])

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(d):
            x[k + 1 :] = x[k + 1 :] - m[k + 1 :, k] * x[k]
        for k in range(d - 1, -1, -1):
            x[k] = x[k] / m[k, k]
            x[:k] = x[:k] - m[:k, k] * x[k]
        return x

    found: list[np.ndarray] = []
    for nth in range(times):
        x = np.array([Decimal(((i + 1) * (2654435761 + 40503 * nth)) % 104729 - 52000) for i in range(d)], dtype=object)
        for _ in range(STEPS):
            x = solved(x)
            for _ in range(2):
                for v in found:
                    x = x - v * (x @ v)
                x = x / (x @ x).sqrt()
        found.append(x)
    return found


def _components(frames: Iterator[pd.DataFrame], matrix: list[list[int]]) -> Iterator[pd.DataFrame]:
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    for frame in frames:
        out = []
        with localcontext() as context:
            context.prec = DIGITS
            scaled = np.array([[Decimal(x) / trace for x in row] for row in matrix], dtype=object)
            for nth, root, bits, times in frame[["nth", "root", "bits", "times"]].itertuples(index=False):
                vectors = _null_space(scaled, Decimal(root) / (1 << bits) / trace, times)
                out += [(nth, i, [str(int((x * (1 << SCALE)).to_integral_value())) for x in v]) for i, v in enumerate(vectors)]
        yield pd.DataFrame(out, columns=["nth", "copy", "vector"])


@dataclass
class Whitening:
    """n vectors with sums per dimension; unit components by falling eigenvalue, times 2^SCALE and rounded; explained shares."""

    n: int
    sums: list[int]
    eigenvalues: list[float]
    explained: list[float | None]
    components: list[list[int]]


def fitted(rows: DataFrame, dims: int, n: int, k: int) -> Whitening:
    """The whitening of rows with x, an array of `dims` longs. What the driver gets has the size of the matrix."""
    spark = rows.sparkSession
    sums = _added(rows, _column_sums, (1, dims))[0]
    centre = [s // n for s in sums]
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    upper = _added(rows, partial(_products, centre=np.array(centre, dtype=np.int64)), (dims, dims))
    # n^2 times the covariance: sums of products of entries that are centred, first by whole numbers, then exactly.
    scatter = [[n * upper[min(i, j)][max(i, j)] - left[i] * left[j] for j in range(dims)] for i in range(dims)]
    trace = sum(scatter[i][i] for i in range(dims))
    roots, room = [], k
    for root, bits, times in largest_roots(characteristic_polynomial(spark, scatter), k):
        if room > 0:
            roots.append((len(roots), str(root), bits, min(times, room)))
            room -= times
    found = {}
    live = [r for r in roots if r[1] != "0"]
    if live:
        tasks = spark.createDataFrame(live, "nth int, root string, bits int, times int").repartition(len(live))
        vectors = tasks.mapInPandas(partial(_components, matrix=scatter), "nth int, copy int, vector array<string>").collect()
        found = {(r["nth"], r["copy"]): [int(x) for x in r["vector"]] for r in vectors}
    pairs = [(nth, i, int(root), bits) for nth, root, bits, times in roots for i in range(times)]
    return Whitening(
        n, sums,
        [root / (n * n << bits) for _, _, root, bits in pairs],
        [root / (trace << bits) if trace else None for _, _, root, bits in pairs],
        [found[nth, i] for nth, i, root, _ in pairs if root],
    )


def _whiten(batches: Iterator[pa.RecordBatch], model: Whitening) -> Iterator[pa.RecordBatch]:
    n, d, live = model.n, len(model.sums), len(model.components)
    centre = np.array([s // n for s in model.sums], dtype=np.int64)
    left = np.array([s % n for s in model.sums], dtype=object)
    scale = np.sqrt(np.array(model.eigenvalues[:live]))
    whole = np.array(model.components, dtype=object).reshape(live, d)
    units = (whole / (1 << SCALE)).astype(float)
    for batch in batches:
        if not batch.num_rows:
            continue
        y = _matrix(batch, "x") - centre
        largest = np.abs(y).max(axis=1, initial=0)
        out = np.full((len(y), len(model.eigenvalues)), np.nan)
        out[:, :live] = (y - (left / n).astype(float)) @ units.T / scale
        for i in np.flatnonzero(largest > FAR):
            z = [int(v) * n - r for v, r in zip(y[i], left, strict=True)]
            out[i, :live] = [sum(a * b for a, b in zip(z, w, strict=True)) / (n << SCALE) for w in whole] / scale
        if d * ((int(largest.max()) + 1) * n) ** 2 < 1 << 62:
            deviation = ((y * n - left.astype(np.int64)) ** 2).sum(axis=1).tolist()
        else:
            deviation = [sum((int(v) * n - r) ** 2 for v, r in zip(row, left, strict=True)) for row in y]
        offsets = np.arange(len(y) + 1, dtype=np.int32) * out.shape[1]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"), pa.array([Decimal(v) if v < 10**38 else None for v in deviation], type=pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel(), from_pandas=True)),
            ],
            names=["vec_id", "deviation", "whitened"],
        )


def _spread(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(mean), len(mean)))
    for batch in batches:
        if batch.num_rows:
            w = _matrix(batch, "whitened")[:, : len(mean)] - mean
            total += w.T @ w
    i, j = np.triu_indices(len(mean))
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])


def identity_error(rows: DataFrame, n: int, live: int) -> float | None:
    """The largest absolute entry of the covariance of `whitened` (its first `live` entries), less the identity."""
    if not live:
        return None
    mean = rows.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(live))).first()
    sums = rows.select("whitened").mapInArrow(partial(_spread, mean=np.array(list(mean), dtype=float)), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    return sums.agg(F.max(F.abs(F.col("s") / n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whitened(
    vectors: DataFrame, k: int = 32, steps: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component up to k.

    An entry c counts as x = floor(steps * c) + shift. Components are unit eigenvectors of the covariance of all x
    (divisor n), of either sign, numbered from 1 by falling eigenvalue e; `whitened` is x less its mean, projected on the
    component, over sqrt(e); `explained` is e's share of the trace; `deviation` is the sum of (n * x - sums)^2, exact as a
    decimal (null beyond 38 digits). `identity_error`, the same in all rows, is measured on the result.

    Vectors that are null, hold null, NaN or infinite entries, or entries whose x is beyond 2^61, are left out, and so
    are those of another length than most vectors have (the shorter among equals). Repeated rows and rows with equal or
    null ids count as they stand. A component without variance, as with one vector, equal vectors or fewer vectors than
    dimensions, has null in `whitened` and 0 in `explained` (null if nothing varies), and is not part of
    `identity_error`. Components of one repeated eigenvalue are any orthonormal set of its space. Other columns are
    ignored; an empty table gives an empty result.

    All sums over rows are exact integers, added up within tasks and then by key. The integer scatter's characteristic
    polynomial comes from its values modulo many primes; the count of sign changes isolates its roots exactly, so equal
    and close eigenvalues are told apart; inverse iteration with 90 digits gives the components. Work beyond the passes
    over the rows grows with the fourth power of the dimensions: it is meant for up to a few hundred.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), entries(F.col(vector_col), steps, shift).alias("x")).where("x IS NOT NULL")
    source = written(source)
    sizes = source.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if sizes is None or not sizes["dims"]:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, n = sizes["dims"], sizes["n"]
    rows = source.where(F.size("x") == dims)
    model = fitted(rows, dims, n, min(k, dims))
    found = written(rows.mapInArrow(partial(_whiten, model=model), "vec_id long, deviation decimal(38,0), whitened array<double>"))
    error = identity_error(found, n, len(model.components))
    explained = F.array(*(F.lit(x).cast("double") for x in model.explained))
    out = found.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation")
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
