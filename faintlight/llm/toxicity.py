"""Toxic passages as maximum-scoring segments of token log-odds (operator 7).

Tokens weigh their log-odds of standing in a toxic document, with an informative Dirichlet prior that follows the
tokens' overall frequency, less one standard deviation, so that rare tokens need more evidence. Tokens whose documents
depart no further from the classes' sizes than chance would let one of so many weigh a little below 0. The linear-time scan of Ruzzo and Tompa finds all maximal segments, and extreme-value
statistics (Karlin and Altschul) tell how far a segment's score goes beyond what clean text of that length holds. The
excess, summed over a document's significant segments, becomes a probability by a logistic curve fitted on labelled
documents other than those that gave the weights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlight.llm.store import written

SAMPLE_DOCS = 20_000
PRIOR = 50.0
DRIFT = 0.5
LEAST_DOCS = 3

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in one pass (Ruzzo and Tompa, 1999)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        start, end, left, right = i, i + 1, before, total
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, left, right))
    return [(s, e, r - l) for s, e, l, r in found]


def text_segments(words: list[str], weights: dict[str, float]) -> list[tuple[int, int, float]]:
    """The maximal segments over token positions. Stretches between tokens of positive weight are summed up first."""
    values = [*map(weights.get, words)]
    places = [i for i, v in enumerate(values) if v is not None and v > 0]
    if not places:
        return []
    scores, at, after = [], [], 0
    for i in places:
        if i > after:
            scores.append(sum(-DRIFT if v is None else v for v in values[after:i]))
            at.append(after)
        scores.append(values[i])
        at.append(i)
        after = i + 1
    at.append(after)
    return [(at[s], at[e], score) for s, e, score in maximal_segments(scores)]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs: Counter = Counter()
        times: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for token, n in Counter(tokens(text or "")).items():
                docs[token, toxic] += 1
                times[token, toxic] += n
        keys = list(docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([times[k] for k in keys], pa.int64())],
            names=["token", "toxic", "docs", "times"],
        )


def log_odds(docs1: np.ndarray, docs0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The tokens' log-odds of standing in a document of class 1, less one standard deviation where positive."""
    share = (docs1 + docs0) / (n1 + n0)
    a1, a0 = docs1 + PRIOR * share, docs0 + PRIOR * share
    b1, b0 = n1 + PRIOR - a1, n0 + PRIOR - a0
    odds = np.log(a1 / np.maximum(b1, 1e-9)) - np.log(a0 / np.maximum(b0, 1e-9))
    spread = np.sqrt(1 / a1 + 1 / a0)
    return np.sign(odds) * np.maximum(np.abs(odds) - spread, 0.0)


def deviance(docs1: np.ndarray, docs0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Twice the log-likelihood ratio by which the tokens' documents of class 1 depart from the classes' sizes."""
    docs = docs1 + docs0
    part = lambda seen, share: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / (docs * share)), 0.0)
    return 2 * (part(docs1, n1 / (n1 + n0)) + part(docs0, n0 / (n1 + n0)))


def _evidence(n_tokens: int, segments: list[tuple[int, int, float]], model: dict) -> float:
    bar = math.log(max(model["k"] * n_tokens, 1e-9))
    return sum(max(0.0, model["rate"] * score - bar) for _, _, score in segments)


def _features(batches: Iterator[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            words = tokens(text or "")
            rows.append((len(words), [s for _, _, s in text_segments(words, weights)]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))],
            names=["toxic", "n", "segments"],
        )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve, by Newton's method with a light ridge."""
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 1e-3 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learned(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample_docs: int = SAMPLE_DOCS,
) -> dict:
    """A model from at most `sample_docs` labelled documents, the first by a hash of their ids.

    Half of them give the token weights (of all tokens that stand in LEAST_DOCS or more documents), the others the
    calibration. Labels other than 0 and 1, null ids and labelled ids without a document teach nothing; an id with
    several labels counts as toxic if one of them is 1. Without labels of both kinds every score is 0.5 or less.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    place = F.md5(F.col("id").cast("string"))
    chosen = written(known.withColumn("place", place).orderBy("place").limit(sample_docs))
    sample = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), "id")
        .select("text", "toxic", (F.conv(F.substring("place", 1, 4), 16, 10).cast("int") % 2).alias("half"))
    )
    sample = written(sample)
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get((0, 1), 0), sizes.get((0, 0), 0)
    model = {"weights": {}, "rate": 1.0, "k": 1.0, "curve": (-5.0, 0.0)}
    if not (n1 and n0):
        return model
    first = sample.where("half = 0").select("text", "toxic").mapInArrow(_token_counts, "token string, toxic int, docs long, times long")
    of = lambda c, k: F.sum(F.when(F.col("toxic") == k, F.col(c)).otherwise(0))
    counts = first.groupBy("token").agg(of("docs", 1).alias("d1"), of("docs", 0).alias("d0"), of("times", 0).alias("t0"))
    all_words = counts.agg(F.sum("t0")).first()[0] or 1
    top = counts.where(F.col("d1") + F.col("d0") >= LEAST_DOCS).toPandas().sort_values("token")
    if not len(top):
        return model
    odds = np.clip(log_odds(top["d1"].to_numpy(float), top["d0"].to_numpy(float), n1, n0) - DRIFT / 2, -1.0, 8.0)
    # As many tests as tokens: chance alone hardly ever lifts one of m tokens over 2 log m.
    telling = deviance(top["d1"].to_numpy(float), top["d0"].to_numpy(float), n1, n0) >= 2 * math.log(len(top) + 1)
    informed = telling & ((odds > 0) | (odds < -DRIFT))
    weights = model["weights"] = dict(zip(top["token"][informed], odds[informed].tolist(), strict=True))
    share = top["t0"].to_numpy(float)[informed] / all_words
    value = odds[informed]
    low, high = 1e-6, 20.0
    for _ in range(60):  # the rate at which clean text's expected exponential score is 1
        rate = (low + high) / 2
        excess = (share * np.exp(np.minimum(rate * value, 500))).sum() + (1 - share.sum()) * math.exp(-rate * DRIFT) - 1
        low, high = (rate, high) if excess < 0 else (low, rate)
    model["rate"] = low
    rest = sample.where("half = 1").select("text", "toxic").mapInArrow(partial(_features, weights=weights), "toxic int, n long, segments array<double>").toPandas()
    clean = rest[rest["toxic"] == 0]
    if len(clean):
        best = np.array([max(s, default=0.0) for s in clean["segments"]])
        model["k"] = max(1e-9, len(clean) / max(1e-9, float((np.maximum(clean["n"], 1) * np.exp(-low * best)).sum())))
    evidence = np.array([_evidence(n, [(0, 0, x) for x in s], model) for n, s in zip(rest["n"], rest["segments"], strict=True)])
    if rest["toxic"].nunique() == 2:
        intercept, slope = _logistic(np.log1p(evidence), rest["toxic"].to_numpy(float))
        model["curve"] = (intercept, max(0.0, slope))
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: dict, passages: bool) -> Iterator[pa.RecordBatch]:
    intercept, slope = model["curve"]
    for whole in batches:
        for start in range(0, whole.num_rows, 512):
            batch = whole.slice(start, 512)
            scores, found = [], []
            for text in batch.column("text").to_pylist():
                words = tokens(text or "")
                segments = text_segments(words, model["weights"])
                scores.append(1 / (1 + math.exp(-intercept - slope * math.log1p(_evidence(len(words), segments, model)))))
                bar = math.log(max(model["k"] * len(words), 1e-9))
                found.append([{"start": s, "end": e, "score": x} for s, e, x in segments if model["rate"] * x > bar])
            columns = [*batch.drop_columns(["text"]).columns, pa.array(scores, pa.float64())]
            names = [*(n for n in batch.schema.names if n != "text"), "score"]
            if passages:
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                names.append("passages")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def scored(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[Column | str, ...] = ("doc_id",), passages: bool = True) -> DataFrame:
    """The columns `keep` of docs with score (0 to 1) and passages, the significant segments by token position.

    Whole texts are read; null and empty texts hold no segment and get the score of clean text. Only the text and the
    model decide; repeated rows and rows without an id are scored like others; empty tables stay empty.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", score double"
    if passages:
        schema += ", passages array<struct<start: int, end: int, score: double>>"
    return rows.mapInArrow(partial(_scores, model=model, passages=passages), schema)
