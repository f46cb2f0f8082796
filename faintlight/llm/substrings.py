"""Removal of word windows that stood in an earlier document, behind a count-min sketch (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faintlight.llm import repeats
from faintlight.llm.store import written
from faintlight.llm.tokens import Texts, anchors, chunks, mix

GRAM = 25
DEPTH = 2
WIDTH = 1 << 32


def cells(grams: np.ndarray, depth: int, width: int) -> list[np.ndarray]:
    """The sketch cell of each gram in each of the sketch's rows."""
    seeds = (np.uint64((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for r in range(depth))
    return [(mix(grams + seed) % np.uint64(width)).astype(np.int64) + r * width for r, seed in enumerate(seeds)]


def _sketch(batches: Iterator[pa.RecordBatch], window: int, gram: int, depth: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [anchors(*repeats.codes_of(texts, "word"), window, gram)["gram"] for texts in chunks(batch.column("text"))]
        cell, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *cells(np.concatenate(grams), depth, width)]) if grams else np.zeros(0, dtype=np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])


def _with_cells(batches: Iterator[pa.RecordBatch], window: int, gram: int, depth: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in repeats.run_rows(batches, "word", window, gram):
        grams = batch.column("gram").to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *(pa.array(x) for x in cells(grams, depth, width))],
            names=[*batch.schema.names, *(f"cell{r}" for r in range(depth))],
        )


def _keep(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    first, last, _ = Texts(text, np.array([0, len(text)]), 0).words()
    gone = np.zeros(len(first) + 1, dtype=np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    raw = text.tobytes()
    return len(first), len(first) - len(left), b" ".join([raw[a:b] for a, b in zip(first[left].tolist(), last[left].tolist(), strict=True)])


def _digest(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    n, removed, kept = _keep(text, starts, ends)
    return n, removed, hashlib.sha256(kept).hexdigest()


def _text(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    n, removed, kept = _keep(text, starts, ends)
    return n, removed, kept.decode()


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = GRAM,
    depth: int = DEPTH, width: int = WIDTH, digest: bool = False,
) -> DataFrame:
    """Texts without the words covered by a window that also starts in a document with a smaller id.

    First pass: every partition counts its windows in a count-min sketch of `depth` rows with `width` cells, kept sparse;
    Spark adds the sketches up cell by cell. A window's cell is a hash of its anchor gram, which its own content chooses,
    and neighbouring windows with one anchor are counted in one go: such a run holds a window once at most, so a window
    that stands n times is counted n times at least, and cells of count 1 hold no repeated window. Second pass: only runs whose cells all count two or
    more are grouped exactly, first by content, then, where contents differ, window by window. Width bounds nothing
    but the share of grams let through in vain (one in several hundred at 10 million grams).

    Returns one row per input row: doc_id, n_words, n_removed, and text (kept words joined by one space) or, with
    digest=True, kept_sha256. Windows are judged on the input. Null and empty texts have no words. Rows without an id
    are returned whole and make nothing else repeated; rows that share an id never shorten each other. Texts shorter
    than a window stay whole. Other columns are ignored.
    """
    texts = repeats.source(docs, id_col, text_col)
    known = texts.where("doc_id IS NOT NULL")
    shape = dict(window=window, gram=gram, depth=depth, width=width)
    sketch = known.mapInArrow(partial(_sketch, **shape), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    crowded = written(sketch.where("n > 1").select("cell"))
    found = known.mapInArrow(partial(_with_cells, **shape), repeats.RUNS + "".join(f", cell{r} long" for r in range(depth)))
    for r in range(depth):
        found = found.join(crowded.withColumnRenamed("cell", f"cell{r}"), f"cell{r}", "left_semi").drop(f"cell{r}")
    earlier = lambda first, own: first["doc_id"] < own["doc_id"]
    runs = written(repeats.judged_apart(written(found), earlier))
    packed = repeats.packed(texts)
    single = repeats.repeated_windows(repeats.windows(runs.where("NOT covered"), packed, "word", window), earlier)
    spans = repeats.spans_of(runs.where("covered"), single, window)
    last = "kept_sha256" if digest else "text"
    cut = partial(repeats.cut, keep=_digest if digest else _text, names=["n_words", "n_removed", last])
    return packed.join(spans, repeats.KEY, "left").mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {last} string")
