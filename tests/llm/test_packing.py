"""Packing against brute force, and on awkward input."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from faintlight.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                j = bins.index(room)
                place(i + 1, [*bins[:j], room - items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_input():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        counts = {x: items.count(x) for x in items}
        found, held = packing.bin_completion(counts, capacity), {}
        for filling, n in found:
            assert n > 0 and sum(x * k for x, k in filling) <= capacity
            for x, k in filling:
                held[x] = held.get(x, 0) + k * n
        assert held == counts
        best = fewest(items, capacity)
        assert sum(n for _, n in found) == best >= packing.waste_bound(counts, capacity)


def test_bin_completion_beats_best_fit_and_keeps_counts_apart_from_their_number():
    rng = random.Random(2)
    counts = {}
    for _ in range(200):
        a, b = rng.randint(500, 800), rng.randint(500, 800)
        for x in (a, b, 2048 - a - b):
            counts[x] = counts.get(x, 0) + 1
    n = lambda found: sum(k for _, k in found)
    assert n(packing.bin_completion(counts)) < n(packing.best_fit(counts, 2048))
    many = {x: k * 10**9 for x, k in counts.items()}
    assert 200 * 10**9 <= n(packing.bin_completion(many)) <= n(packing.best_fit(many, 2048))
    assert packing.bin_completion({}) == []
    with pytest.raises(ValueError, match="longer"):
        packing.bin_completion({11: 1}, 10)


def test_dominance():
    assert packing.dominates(((7, 1),), ((4, 1), (3, 1)))
    assert packing.dominates(((5, 1), (4, 1)), ((4, 2),))
    assert not packing.dominates(((4, 2),), ((5, 1),))


TEXTS = [
    "Hello there, it's 12 o'clock", "", None, "   \n\t ", "ä ö ü \x1c x y", "<|endoftext|> is text", "word " * 5000, "x" * 3000,
    "don't 'S ’s 日本語テキスト", "Hello there, it's 12 o'clock", "á e ́b", "ΟΔΟΣ Σ", "🙂🙂 ‍",
]


def expected(texts, capacity):
    tokenizer, out = Tokenizer.from_file(PATH), []
    tokenizer.encode_special_tokens = True
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            out.append((i, piece, start, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), part))
    return out


@pytest.mark.parametrize("capacity", [7, 2048])
def test_packed_pieces(spark, capacity):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("ids", F.lit(1))
    rows = packing.packed(packing.pieces(docs.repartition(3), PATH, capacity, keep_ids=True), capacity).cache()
    got = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows.collect())
    assert got == expected(TEXTS, capacity)
    check_places(rows.collect(), capacity)
    whole = {r["sequence_id"]: r for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        s = whole[r["sequence_id"]]
        assert s["ids"][r["offset"] : r["offset"] + r["length"]] == r["ids"] and len(s["ids"]) <= capacity
        assert (r["doc_id"], r["offset"]) in zip(s["doc_ids"], s["starts"], strict=True)


def check_places(rows, capacity):
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_takes_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (None, None), (2, "c")], "doc_id long, text string")
    rows = packing.packed(packing.pieces(docs, PATH, 4), 4).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 1), (0, 3), (1, 3), (1, 3), (2, 2)]
    assert check_places(rows, 4) == 4
    assert packing.packed(packing.pieces(docs.limit(0), PATH)).collect() == []


def test_packing_query(spark):
    rows = queries.op13_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    ids = {}
    for i, *rest, _ in expected([d["text"] for d in docs], 2048):
        ids.setdefault(docs[i]["doc_id"], []).append(tuple(rest))
    found = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        found.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert found == ids
    counts = {}
    for r in rows:
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    assert check_places(rows, 2048) <= packing.waste_bound(counts, 2048) + 1
