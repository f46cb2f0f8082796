"""What both removals of repeated windows (operators 8 and 10) share: runs of windows, their windows, and cutting.

A document's windows are far too many to be shuffled one by one. anchors() sums them up in runs: neighbouring windows
with the same content-chosen anchor. Equal windows stand in runs with equal anchor grams, so

* a run whose gram occurs once has no repeated window;
* a run with the same content as an earlier run is repeated as a whole;
* only first runs that share their gram with other first runs are looked at closer, by blocks of windows or one by one.

Texts travel packed (zstd), with `part`, which tells rows apart that share an id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.store import written
from faintlight.llm.tokens import BYTE_CODES, Texts, anchors, chunks, mix, prefix_sums, span_hash

RUNS = "doc_id long, part int, low int, high int, gram long, run long"
RUN_NAMES = ["doc_id", "part", "low", "high", "gram", "run"]
KEY = ["doc_id", "part"]
#: So many runs (some 40 bytes each) a task holds at a time to settle equal ones.
SEGMENT = 2_000_000
#: So many neighbouring windows are judged together before they are judged one by one.
BLOCK = 8


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, text). Part is 0 where no id repeats, which packs better in the shuffles, else a checksum."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    unique = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    checksum = F.lit(0) if unique else F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    return texts.select("doc_id", (checksum - F.lit(1 << 31)).cast("int").alias("part") if not unique else checksum.alias("part"), "text")


def codes_of(texts: Texts, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts' units (bytes or words) and the place of each row's first unit."""
    if unit == "byte":
        return BYTE_CODES[texts.data], texts.offsets
    codes, _, _, places = texts.word_codes(lower=False)
    return codes, places


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _found(batch: pa.RecordBatch, texts: Texts, found: dict[str, np.ndarray]) -> list[pa.Array]:
    place = pa.array(found["row"] + texts.first)
    return [
        batch.column("doc_id").take(place), batch.column("part").take(place), pa.array(found["low"].astype(np.int32)),
        pa.array(found["high"].astype(np.int32)), _signed(found["gram"]), _signed(found["run"]),
    ]


def run_rows(batches: Iterator[pa.RecordBatch], unit: str, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS from (doc_id, part, text)."""
    for batch in batches:
        for texts in chunks(batch.column("text")):
            yield pa.RecordBatch.from_arrays(_found(batch, texts, anchors(*codes_of(texts, unit), window, gram)), names=RUN_NAMES)


def covered_here(doc: np.ndarray, part: np.ndarray, low: np.ndarray, gram: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which runs have the content of another one of these that stands earlier."""
    place = np.lexsort((low, part, doc))
    rank = np.empty(len(doc), dtype=np.int64)
    rank[place] = np.arange(len(doc))
    order = np.lexsort((rank, run, gram))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (run[order][1:] != run[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    covered = np.zeros(len(order), dtype=bool)
    covered[order] = (doc[order] != doc[first]) | (part[order] != part[first]) | (low[order] != low[first])
    return covered


def settled_rows(batches: Iterator[pa.RecordBatch], unit: str, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS; of runs with equal content in a segment of SEGMENT runs only the earliest goes on to be judged.

    The later ones are covered in any case. They come as spans of neighbouring runs, with no `run` and a gram of their
    own, so that the shuffle gets few rows for content that very many documents share."""

    def settled(parts: list[list[pa.Array]]) -> pa.RecordBatch:
        columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)]
        doc, part, low, high, gram_, run = (c.to_numpy() for c in columns)
        gone = covered_here(doc, part, low, gram_, run)
        starts = gone.copy()
        starts[1:] &= ~(gone[:-1] & (doc[1:] == doc[:-1]) & (part[1:] == part[:-1]) & (low[1:] == high[:-1] + 1))
        ends = gone.copy()
        ends[:-1] &= ~(gone[1:] & ~starts[1:])
        first, last, kept = np.flatnonzero(starts), np.flatnonzero(ends), np.flatnonzero(~gone)
        own = mix(doc[first].astype(np.uint64) + mix(low[first].astype(np.uint64)))
        spans = [doc[first], part[first], low[first], high[last], own.view(np.int64)]
        whole = [pa.array(np.concatenate([x[kept], y])) for x, y in zip((doc, part, low, high, gram_), spans, strict=True)]
        return pa.RecordBatch.from_arrays([*whole, pa.concat_arrays([pa.array(run[kept]), pa.nulls(len(first), pa.int64())])], names=RUN_NAMES)

    parts, n = [], 0
    for batch in batches:
        for texts in chunks(batch.column("text")):
            parts.append(_found(batch, texts, anchors(*codes_of(texts, unit), window, gram)))
            n += len(parts[-1][0])
            if n >= SEGMENT:
                yield settled(parts)
                parts, n = [], 0
    if n:
        yield settled(parts)


def runs(texts: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """Rows of RUNS for all texts with an id; see settled_rows() for those without `run`."""
    return texts.where("doc_id IS NOT NULL").mapInArrow(partial(settled_rows, unit=unit, window=window, gram=gram), RUNS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for texts in chunks(batch.column("text")):
            packed = [packer.compress(texts.row(r).tobytes()) for r in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(texts.first, len(texts)) for c in KEY), pa.array(packed, pa.binary())],
                names=["doc_id", "part", "packed"],
            )


def packed(texts: DataFrame) -> DataFrame:
    """(doc_id, part, packed) of every row."""
    return texts.mapInArrow(_pack, "doc_id long, part int, packed binary")


def _unpacked(column: pa.Array) -> Iterator[Texts]:
    unpacker = zstandard.ZstdDecompressor()
    for start in range(0, len(column), 64):
        texts = pa.array([unpacker.decompress(x.as_py()) for x in column.slice(start, 64)], pa.binary())
        for piece in chunks(texts.cast(pa.string())):
            piece.first += start
            yield piece


def _asked(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[tuple]:
    """Texts with the runs asked for: the batch, prefix sums, and for each run its row, first unit, low, high and gram."""
    for whole in batches:
        batch = whole.filter(whole.column("asked").is_valid())
        for texts in _unpacked(batch.column("packed")):
            codes, places = codes_of(texts, unit)
            asked = batch.column("asked").slice(texts.first, len(texts))
            row = np.repeat(np.arange(len(texts)), asked.value_lengths().to_numpy(zero_copy_only=False))
            each = asked.flatten()
            low, high = (each.field(n).to_numpy().astype(np.int64) for n in ("low", "high"))
            yield batch, prefix_sums(codes), row + texts.first, places[row], low, high, each.field("gram").to_numpy().view(np.uint64)


def _windows(batches: Iterator[pa.RecordBatch], unit: str, window: int) -> Iterator[pa.RecordBatch]:
    for batch, sums, row, origin, low, high, gram in _asked(batches, unit):
        size = high - low + 1
        owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        start = at + origin[owner]
        place = pa.array(row[owner])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(place), batch.column("part").take(place), pa.array(at.astype(np.int32)), _signed(gram[owner]), _signed(span_hash(sums, start, start + window))],
            names=["doc_id", "part", "at", "gram", "window"],
        )


def _blocks(batches: Iterator[pa.RecordBatch], unit: str, window: int, gram: int, block: int) -> Iterator[pa.RecordBatch]:
    for batch, sums, row, origin, low, high, grams in _asked(batches, unit):
        places = (origin + low)[:, None] + np.arange(window - gram + 1)
        anchor = low + (span_hash(sums, places, places + gram) == grams[:, None]).argmax(axis=1)
        least, most = (anchor - high) // block, (anchor - low) // block
        size = most - least + 1
        owner = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + least[owner]
        before = block * nth
        first = np.maximum(low[owner], anchor[owner] - before - block + 1)
        last = np.minimum(high[owner], anchor[owner] - before)
        shift = origin[owner]
        core = anchor[owner] + shift - before
        key = mix(span_hash(sums, core, core - block + 1 + window) + mix(grams[owner] + nth.astype(np.uint64)))
        content = mix(span_hash(sums, first + shift, last + shift + window) + (anchor[owner] - first).astype(np.uint64))
        place = pa.array(row[owner])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(place), batch.column("part").take(place), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), _signed(key), _signed(content)],
            names=RUN_NAMES,
        )


def _with_texts(asked: DataFrame, packed_: DataFrame) -> DataFrame:
    """A left join, so that its shuffle of the packed texts is the same as that of the last join, which reuses it."""
    lists = asked.groupBy(*KEY).agg(F.collect_set(F.struct("low", "high", "gram")).alias("asked"))
    return packed_.join(lists, KEY, "left")


def windows(asked: DataFrame, packed_: DataFrame, unit: str, window: int) -> DataFrame:
    """(doc_id, part, at, gram, window): every window of the runs asked for, with a hash of its content."""
    return _with_texts(asked, packed_).mapInArrow(partial(_windows, unit=unit, window=window), "doc_id long, part int, at int, gram long, window long")


def blocks(asked: DataFrame, packed_: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """Rows of RUNS for blocks of BLOCK windows, counted from the anchor, of the runs asked for.

    All windows of a block hold the units from its last window's start to its first one's end; their hash is the block's
    gram. So equal windows stand in blocks with equal grams, wherever their runs end."""
    return _with_texts(asked, packed_).mapInArrow(partial(_blocks, unit=unit, window=window, gram=gram, block=BLOCK), RUNS)


def judged(found: DataFrame, earlier: Callable) -> DataFrame:
    """Runs whose gram occurs more than once, with `covered` (the content stood earlier) and `several` (the gram has other contents)."""
    by_gram, by_run = Window.partitionBy("gram"), Window.partitionBy("gram", "run")
    return (
        found.withColumn("first", F.min(F.struct("doc_id", "part", "low")).over(by_run))
        .withColumn("times", F.count("*").over(by_gram))
        .withColumn("several", F.min("run").over(by_gram) < F.max("run").over(by_gram))
        .where("times > 1 OR run IS NULL")
        .withColumn("covered", F.col("run").isNull() | earlier(F.col("first"), F.struct("doc_id", "part", "low")))
        .where("covered OR several")
        .select("doc_id", "part", "low", "high", F.when(~F.col("covered"), F.col("gram")).alias("gram"), "covered")
    )


def judged_apart(found: DataFrame, earlier: Callable) -> DataFrame:
    """What judged() gives, from a written table of runs of which few are left.

    Contents are summed up before they are sent to their gram, and the sums are tables of their own, so that Spark can
    split the joins where a gram is very common."""
    contents = found.groupBy("gram", "run").agg(F.min(F.struct("doc_id", "part", "low")).alias("first"), F.count("*").alias("times"))
    contents = written(contents)
    grams = written(contents.groupBy("gram").agg(F.sum("times").alias("times"), (F.min("run") < F.max("run")).alias("several")).where("times > 1").drop("times"))
    return (
        found.join(contents.select("gram", "run", "first"), ["gram", "run"])
        .join(grams, "gram")
        .withColumn("covered", earlier(F.col("first"), F.struct("doc_id", "part", "low")))
        .where("covered OR several")
        .select("doc_id", "part", "low", "high", F.when(~F.col("covered"), F.col("gram")).alias("gram"), "covered")
    )


def repeated_windows(found: DataFrame, earlier: Callable) -> DataFrame:
    """(doc_id, part, at) of the windows that stood earlier."""
    place = F.struct("doc_id", "part", "at")
    first = F.min(place).over(Window.partitionBy("gram", "window"))
    return found.withColumn("first", first).where(earlier(F.col("first"), place)).select("doc_id", "part", "at")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as sorted spans with gaps between them."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends


def cut(batches: Iterator[pa.RecordBatch], keep: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Applies keep(text, spans' starts, spans' ends) to each row of (doc_id, part, packed, spans)."""
    for batch in batches:
        for texts in _unpacked(batch.column("packed")):
            spans = batch.column("spans").slice(texts.first, len(texts))
            size = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            each, ends = spans.flatten(), np.append(0, np.cumsum(size)).astype(np.int64)
            low, high = (each.field(n).to_numpy() for n in ("start", "end"))
            rows = [keep(texts.row(r), *merged(low[ends[r] : ends[r + 1]], high[ends[r] : ends[r + 1]])) for r in range(len(texts))]
            columns = [pa.array(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)), *columns], names=["doc_id", *names])


def spans_of(runs_: DataFrame, single: DataFrame, window: int) -> DataFrame:
    """(doc_id, part, spans) from covered runs and single windows."""
    both = runs_.select(*KEY, F.col("low").alias("start"), (F.col("high") + window).alias("end")).union(
        single.select(*KEY, F.col("at").alias("start"), (F.col("at") + window).alias("end"))
    )
    return both.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
