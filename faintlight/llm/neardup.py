"""Near-duplicate documents by fast similarity sketching (operator 1).

Sketches (Dahlgaard, Knudsen and Thorup, 2017): in round i every shingle is hashed to one of t bins with a value in
[i, i + 1), and an empty bin keeps the smallest value thrown into it. From round t on, round t + j throws all shingles
into bin j, so after at most 2t rounds every bin is filled; for long texts two or three rounds do. Two sketches agree
in a bin with a probability equal to the similarity of the sets, and the bins are nearly independent.

Bands of four bins then propose candidates, and every link is confirmed on the full shingle sets. What the first links
leave apart in a bucket is compared without loss: two sets that are similar enough share one of their rarest shingles,
in places that leave room for enough others (prefix and position filters), and bitmaps of shingle parities bound their
difference from below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.components import components
from faintlight.llm.store import dropped, small, written
from faintlight.llm.tokens import chunks, mix, shingle_sets

BINS = 128
BAND = 4
#: Cells of the bitmaps: a bit says whether an odd number of the set's shingles fall into the cell. 64 to a column.
CELLS = 1024
BITS = [f"bits{i}" for i in range(CELLS // 64)]
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(hashes: np.ndarray, rows: np.ndarray, n: int, bins: int = BINS) -> np.ndarray:
    """The sketches of n sets, given all elements' hashes and the set that each belongs to; empty sets stay unfilled."""
    out = np.full(n * bins, _EMPTY, dtype=np.uint64)
    low = np.uint64((1 << 48) - 1)
    shift = np.uint64(64 - int(math.log2(bins)))
    i = 0
    while i < 2 * bins and len(hashes):
        # Several rounds at once where few elements are left; later rounds' values are larger and displace nothing.
        turns = np.arange(i, min(2 * bins, i + max(1, (1 << 15) // len(hashes))))
        x = mix(hashes + ((turns + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None])
        bin_ = np.where(turns[:, None] < bins, (x >> shift).astype(np.int64), (turns - bins)[:, None])
        cell = rows * bins + bin_
        open_ = out[cell] == _EMPTY
        values = (x & low) | (turns.astype(np.uint64) << np.uint64(48))[:, None]
        np.minimum.at(out, cell[open_], values[open_])
        i = int(turns[-1]) + 1
        live = np.unique(rows)
        done = np.zeros(n, dtype=bool)
        done[live] = ~(out.reshape(n, bins)[live] == _EMPTY).any(axis=1)
        left = ~done[rows]
        hashes, rows = hashes[left], rows[left]
    return out.reshape(n, bins)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values))


def _keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """Names of sets: equal for equal sets, None for empty ones."""
    return [
        np.array([s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64) + np.uint64(len(s))]).tobytes() if len(s) else None
        for s in sets
    ]


def _summaries(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(1)):
                sets = shingle_sets(texts, width)
                sizes = np.array([len(s) for s in sets])
                rows = np.repeat(np.arange(len(sets)), sizes)
                table = sketches(np.concatenate(sets), rows, len(sets))
                bands = mix(table.reshape(len(sets), -1, BAND) + np.arange(BAND, dtype=np.uint64))
                bands = mix(bands.sum(axis=2, dtype=np.uint64) + np.arange(BINS // BAND, dtype=np.uint64))
                full = sizes > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)),
                        pa.array(sizes),
                        pa.array(_keys(sets), pa.binary()),
                        _ragged(_signed(bands[full].ravel()), np.where(full, BINS // BAND, 0)),
                        batch.column(2).slice(texts.first, len(texts)),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "part"],
                )

    return task


def parities(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The bitmaps of n sets. Two bitmaps differ in at most as many bits as their sets differ in elements."""
    cell = (mix(hashes + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - int(math.log2(CELLS)))).astype(np.int64)
    odd = np.bincount(rows * CELLS + cell, minlength=n * CELLS).reshape(n, CELLS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _whole_sets(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in chunks(batch.column(0)):
                sets = shingle_sets(texts, width)
                sizes = np.array([len(s) for s in sets])
                hashes = np.concatenate(sets)
                bits = parities(hashes, np.repeat(np.arange(len(sets)), sizes), len(sets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(sets), pa.binary()), _ragged(_signed(hashes), sizes), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)],
                    names=["set_key", "hashes", *BITS],
                )

    return task


def _fits(m: Column, n: Column, percent: int) -> Column:
    """Whether sets of m and n elements can be similar enough."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _plausible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps don't rule out; none that is similar enough goes."""
    side = lambda x: bits.select(F.col("set_key").alias(x), F.struct("n", *BITS).alias(f"of_{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    m, n = F.col("of_a.n"), F.col("of_b.n")
    differing = sum((F.bit_count(F.col(f"of_a.{x}").bitwiseXOR(F.col(f"of_b.{x}"))) for x in BITS), F.lit(0))
    return pairs.where(_fits(m, n, percent) & ((100 + percent) * (m + n - differing) >= 2 * percent * (m + n))).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, whose sets have 100 * intersection >= percent * union.

    Where many pairs share their a, its set is copied to a few salted places so that no task gets all of them.
    """
    per_place = 256
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_place).cast("int").alias("places"))
    pairs = pairs.join(degree, "a").withColumn("place", F.pmod(F.xxhash64("b"), F.col("places")).cast("int"))
    left = sets.select(F.col("set_key").alias("a"), F.col("hashes").alias("a_hashes")).join(small(degree), "a")
    left = left.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).drop("places")
    right = sets.select(F.col("set_key").alias("b"), F.col("hashes").alias("b_hashes")).join(small(pairs.drop("places")), "b")
    both = right.join(left, ["a", "place"])
    shared = F.size(F.array_intersect("a_hashes", "b_hashes"))
    union = F.size("a_hashes") + F.size("b_hashes") - shared
    return both.where(100 * shared >= percent * union).select("a", "b").distinct()


def _prefixes(tokens: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """The rows (set_key, token, place, n, label) with each set's rarest shingles that others have too.

    Shingles stand in one order, the rarest first. Of sets that are similar enough each holds percent of the other, so
    the first n - ceil(percent * n / 100) + 1 shingles of both have one in common. Shingles that no other set has come
    first, and can be counted without being sent around.
    """
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("set_key")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "token"))
    rows = tokens.join(often, "token").join(open_, "set_key").withColumn("place", place)
    return rows.where(100 * (F.col("n") - F.col("place") + 1) >= percent * F.col("n")).select("set_key", "token", "place", "n", "label")


def _apart(x: str, y: str, percent: int) -> Column:
    """Whether sets x and y that share a shingle in these places are in different groups and can be similar enough."""
    field = lambda side, name: F.col(f"{side}.{name}")
    m, n = field(x, "n"), field(y, "n")
    room = 1 + F.least(m - field(x, "place"), n - field(y, "place"))
    return (field(x, "label") != field(y, "label")) & _fits(m, n, percent) & ((100 + percent) * room >= percent * (m + n))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets are linked, directly or over others.

    Shingles are runs of `width` lower-cased words; a text with fewer words is one shingle. Documents are linked where
    100 * intersection >= percent * union. Returns one row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id that can be reached), kept (doc_id = component_id), n_links (the other distinct sets that it was compared
    with and linked to).

    A text that is null or has no word has no shingles and is linked with nothing: it is its own component and kept.
    A row without an id has no component but is kept. Repeated rows are copies of each other and share an id, so all of
    them are kept; an id with several texts may stand in several components. Other columns are ignored.

    Copies meet in one set first. Banded sketches then propose: each set with the one of its buckets that meets most
    others over all buckets, as the original of many copies does. Sets whose buckets still hold several groups after
    that are searched without loss by their rarest shingles: first each with the most common of those it meets, then
    all pairs that are still apart. A pair at 0.8 shares no bucket with a probability under 1e-7; nothing else is lost.

    Very long texts are cut into bounded arrays of hashes one at a time. Tables in the shared folder that only this
    function reads are deleted on the way.
    """
    spark = docs.sparkSession
    used: list[str] = []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("part", F.xxhash64("text"))
    summary = written(
        source.mapInArrow(
            _summaries(width), "doc_id long, n_shingles long, set_key binary, bands array<long>, part long"
        )
    )
    distinct = written(
        summary.where("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands"),
            F.min(F.struct("doc_id", "part")).alias("sample"),
        ),
        used,
    )
    placed = distinct.select("set_key", "n", F.explode("bands").alias("band"))
    shared = written(placed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), used)
    crowded = written(placed.join(small(shared), "band"), used)
    keys = written(crowded.groupBy("set_key").agg(F.sum("members").alias("met")), used)
    wanted = distinct.join(small(keys), "set_key", "left_semi")
    wanted = written(wanted.select(F.col("sample.doc_id").alias("wanted_id"), F.col("sample.part").alias("wanted_part")), used)
    has = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("part") == F.col("wanted_part"))
    sets = written(
        source.join(small(wanted), has, "left_semi")
        .select("text")
        .mapInArrow(_whole_sets(width), "set_key binary, hashes array<long>" + "".join(f", {b} long" for b in BITS))
        .groupBy("set_key")
        .agg(*(F.any_value(c).alias(c) for c in ["hashes", *BITS])),
        used,
    )
    bits = sets.select("set_key", F.size("hashes").alias("n"), *BITS)
    linked = lambda pairs: written(_confirmed(written(_plausible(pairs, bits, percent), used), sets, percent), used)

    members = crowded.join(keys, "set_key")
    centres = members.groupBy("band").agg(F.max(F.struct("met", "set_key", "n")).alias("centre"))
    homes = members.join(centres, "band").where((F.col("set_key") != F.col("centre.set_key")) & _fits(F.col("n"), F.col("centre.n"), percent))
    links = linked(homes.groupBy(F.col("set_key").alias("b")).agg(F.max("centre").alias("c")).select(F.col("c.set_key").alias("a"), "b"))

    labels = components(links, used).withColumnRenamed("node", "set_key")
    rows = crowded.join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    mixed = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")
    open_ = written(rows.join(mixed, "band").select("set_key", "n", "label").distinct(), used)
    if not open_.isEmpty():
        tokens = written(sets.join(small(open_), "set_key", "left_semi").select("set_key", F.explode("hashes").alias("token")), used)
        prefixes = written(_prefixes(tokens, open_, percent), used)
        common = prefixes.groupBy("token").agg(F.min(F.struct("place", "set_key", "n", "label")).alias("y"))
        homes = prefixes.select("token", F.struct("place", "set_key", "n", "label").alias("x")).join(common, "token").where(_apart("x", "y", percent))
        homes = homes.groupBy(F.col("x.set_key").alias("b")).agg(F.min("y").alias("y")).select(F.col("y.set_key").alias("a"), "b")
        links = written(links.union(linked(homes)), used)

        labels = components(links, used).withColumnRenamed("node", "set_key")
        left = prefixes.drop("label").join(labels, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
        left = left.select("token", F.struct("place", "set_key", "n", "label").alias("x"))
        rest = left.join(left.withColumnRenamed("x", "y"), "token").where((F.col("x.set_key") < F.col("y.set_key")) & _apart("x", "y", percent))
        links = written(links.union(linked(rest.select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b")).distinct())).distinct(), used)

    groups = components(links, used).withColumnRenamed("node", "set_key")
    degree = links.select(F.explode(F.array("a", "b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("n_links"))
    ids = distinct.select("set_key", "doc_id").join(groups, "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    smallest = ids.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    per_set = written(ids.join(smallest, "label").join(degree, "set_key", "left").select("set_key", "component_id", "n_links", "label"))
    dropped(spark, used)
    return (
        summary.select("doc_id", "n_shingles", "set_key", "part")
        .join(per_set, "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            "part",
            F.col("label").alias("set_component"),
        )
    )
