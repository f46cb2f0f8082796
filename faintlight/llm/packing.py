"""Packing documents into sequences of a fixed number of tokens by bin completion (operator 13)."""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faintlight.llm.store import small, written

CAPACITY = 2048
PER_BUCKET = 50_000
#: How far the branch-and-bound goes before it keeps its best packing: nodes, fillings that are tried at a node, and steps to look for them. They bound the search's time, not what is packed.
NODES, WIDTH, STEPS = 4_000, 6, 400
#: Tokens and characters of known words that a task keeps at hand before it begins anew.
KEPT_TOKENS, KEPT_CHARS = 4_000_000, 20_000_000
#: Words that are tokenized in one go.
LEARNT = 4096
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Counts = dict[int, int]
#: What a sequence holds: lengths with the number of pieces of that length, and how many sequences are filled so.
Filling = tuple[tuple[int, int], ...]


class Encoder:
    """Token ids of texts by a tokenizer that drops white space, so that a text's ids are those of its words, in order.

    Each distinct word is tokenized once and kept; strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.counts, self.tokens = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.uint32)
        self.n_tokens = self.n_chars = 0

    def learn(self, words: list[str]) -> None:
        for start in range(0, len(words), LEARNT):
            part = words[start : start + LEARNT]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            # A token belongs to the word in which it begins.
            ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
            begins = np.fromiter((x for x, _ in found.offsets), dtype=np.int64, count=len(found))
            reached = np.searchsorted(begins, ends)
            counts, place, n = np.diff(reached, prepend=0), len(self.places), self.n_tokens
            while place + len(part) > len(self.starts):
                self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
            while n + len(found) > len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
            self.tokens[n : n + len(found)] = found.ids
            self.starts[place : place + len(part)], self.counts[place : place + len(part)] = n + reached - counts, counts
            self.places.update(zip(part, range(place, place + len(part)), strict=True))
            self.n_tokens += len(found)
            self.n_chars += int(ends[-1])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if self.n_tokens > KEPT_TOKENS or self.n_chars > KEPT_CHARS:
            self.forget()
        words = [_WORD.findall(t) for t in texts]
        flat = list(chain.from_iterable(words))
        self.learn(list(set(flat).difference(self.places)))
        at = np.fromiter(map(self.places.__getitem__, flat), dtype=np.int32, count=len(flat))
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        found = self.tokens[np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])]
        return np.split(found, ends[np.cumsum([len(w) for w in words])[:-1]])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _by_size(texts: Iterator[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in lists that end with the text that brings them to so many characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, row_id = encoder(path), TaskContext.get().partitionId() << 36
    for batch in batches:
        places, out, ids = [], [], []
        texts = ((t.as_py() or "") for t in batch.column("text"))
        for i, found in enumerate(chain.from_iterable(map(encode.ids, _by_size(texts)))):
            found = np.append(found, np.uint32(end_id)).astype("<u4")
            for piece, start in enumerate(range(0, len(found), capacity)):
                part = found[start : start + capacity]
                places.append(i)
                out.append((piece, start, len(part), zlib.crc32(part.tobytes()), row_id))
                row_id += 1
                if keep_ids:
                    ids.append(part.astype(np.int64))
            if places and (len(places) >= 10_000 or i + 1 == batch.num_rows):
                piece, start, length, crc, row = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                columns = [batch.column("doc_id").take(pa.array(places)), *map(pa.array, (piece.astype(np.int32), start, length, crc, row))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "row_id"]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                places, out, ids = [], [], []


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents as tokens: (doc_id, piece, start, length, ids_crc32, row_id), with keep_ids also `ids`.

    A document is its token ids and then `end_id`; a null or empty text is `end_id` alone. Only what is longer than the
    capacity is cut, into pieces of the capacity, the last of which may be shorter. `tokenizer` is a file for the library
    tokenizers on every executor, of a kind that drops white space (see Encoder). Whole texts of any length are taken, a
    text at a time. Null and repeated ids are rows like all others; `row_id` is a number of the piece's own. Other
    columns of docs are ignored, and an empty table has no pieces.
    """
    kind = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row_id long" + ", ids array<long>" * keep_ids
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(partial(_cut, path=tokenizer, capacity=capacity, end_id=end_id, keep_ids=keep_ids), schema)


def waste_bound(counts: Counts, capacity: int) -> int:
    """The fewest sequences that could do, after Martello and Toth: pieces above capacity - k stand apart from those of
    at least k, those above half of the capacity from each other, and the smaller ones fill what these leave."""
    lengths = sorted(counts)
    best = math.ceil(sum(n * x for x, n in counts.items()) / capacity)
    for k in {0, *(x for x in lengths if 2 * x <= capacity)}:
        alone = sum(counts[x] for x in lengths if x > capacity - k)
        large = [x for x in lengths if x <= capacity - k and 2 * x > capacity]
        room = sum(counts[x] * (capacity - x) for x in large)
        rest = sum(counts[x] * x for x in lengths if 2 * x <= capacity and x >= k)
        best = max(best, alone + sum(counts[x] for x in large) + max(0, math.ceil((rest - room) / capacity)))
    return best


def best_fit(counts: Counts, capacity: int) -> list[tuple[Filling, int]]:
    """Pieces by falling length, each to the fullest sequence that has room; sequences with the same content go together."""
    open_, rooms = {}, 0  # groups of sequences by the room they have left; a bit for each room that occurs

    def put(filling: Filling, n: int, room: int) -> None:
        nonlocal rooms
        if n:
            open_.setdefault(room, []).append((filling, n))
            rooms |= 1 << room

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            enough = rooms >> x
            room = x + (enough & -enough).bit_length() - 1 if enough else capacity
            filling, n = open_[room].pop() if enough else ((), math.ceil(left / (capacity // x)))
            if enough and not open_[room]:
                rooms &= ~(1 << room)
            fit = room // x
            full = min(n, left // fit)
            put((*filling, (x, fit)), full, room - fit * x)
            left -= full * fit
            if full < n and left:
                put((*filling, (x, left)), 1, room - left * x)
                full, left = full + 1, 0
            if enough:
                put(filling, n - full, room)
    return [group for groups in open_.values() for group in groups]


def dominates(a: Filling, b: Filling) -> bool:
    """Whether the pieces of b fit into those of a, several into one where they must: b is then never the better choice."""
    small_ones = [x for x, n in b for _ in range(n)]
    rooms = [x for x, n in a for _ in range(n)]
    if len(small_ones) > 8 or sum(small_ones) > sum(rooms):
        return False

    def place(i: int) -> bool:
        if i == len(small_ones):
            return True
        for j in {r: j for j, r in enumerate(rooms) if r >= small_ones[i]}.values():
            rooms[j] -= small_ones[i]
            done = place(i + 1)
            rooms[j] += small_ones[i]
            if done:
                return True
        return False

    return place(0)


def completions(counts: Counts, lengths: list[int], room: int, most_waste: int) -> list[Filling]:
    """Fillings of the room that no other one found dominates, the fullest first: pieces to go with the largest one left.

    `lengths` holds the lengths that are left, falling. A piece that fills the room exactly dominates everything.
    Else fillings to which nothing can be added are searched in order of their pieces, the longest first.
    """
    if room in counts and counts[room]:
        return [((room, 1),)]
    found: dict[Filling, int] = {}
    steps, exact = 0, 0

    def search(i: int, room: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal steps, exact
        any_fits = False
        for j in range(i, len(lengths)):
            x = lengths[j]
            if x > room or not counts[x]:
                continue
            any_fits = True
            steps += 1
            if steps > STEPS or exact >= WIDTH:
                return
            # Long pieces are taken one by one, and short ones as often as they fit.
            times = min(counts[x], room // x)
            for n in range(times, max(0, times - 2), -1):
                search(j + 1, room - n * x, [*chosen, (x, n)])
        if not any_fits and room <= most_waste:
            found.setdefault(tuple(chosen), room)
            exact += room == 0

    search(0, room, [])
    if not found:  # the search may have ended before its first end
        chosen = []
        for x in lengths:
            if n := min(counts[x], room // x):
                chosen.append((x, n))
                room -= n * x
        return [tuple(chosen)] if room <= most_waste else []
    fullest = heapq.nsmallest(2 * WIDTH, found, key=lambda f: (found[f], [-x for x, _ in f]))
    kept: list[Filling] = []
    for f in fullest:
        if not any(dominates(k, f) for k in kept):
            kept.append(f)
    return kept[:WIDTH]


def bin_completion(counts: Counts, capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Filling, int]]:
    """Sequences for so many pieces of each length: fillings, and how many sequences are filled so.

    Branch and bound: the largest piece left is completed by each undominated filling in turn; equal pieces take the
    same filling as long as the counts and the waste allow, or one at a time. A branch ends where the waste of its sequences is
    more than a better packing than the best known, the incumbent, may have. The first incumbent is that of best fit. The
    search ends when the incumbent reaches the bound below which none can be, or after so many nodes and four for each
    length. Its work depends on the number of different lengths, not on that of pieces.
    """
    counts = {x: n for x, n in counts.items() if n > 0}
    if any(not 0 < x <= capacity for x in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), waste_bound(counts, capacity)
    total = sum(n * x for x, n in counts.items())
    left, lengths = dict(counts), sorted(counts, reverse=True)
    path: list[tuple[Filling, int]] = []
    used = wasted = 0

    def apply(filling: Filling, n: int, sign: int) -> None:
        nonlocal used, wasted
        for x, k in filling:
            left[x] -= sign * k * n
        used += sign * n
        wasted += sign * n * (capacity - sum(x * k for x, k in filling))

    def branches() -> Iterator[tuple[Filling, int]]:
        allowed = (fewest - 1) * capacity - total - wasted
        there = [x for x in lengths if left[x]]
        x = there[0]
        left[x] -= 1
        found = completions(left, there, capacity - x, allowed) if allowed >= 0 else []
        left[x] += 1
        for once in (False, True):
            for f in found:
                whole: dict[int, int] = {x: 1}
                for y, k in f:
                    whole[y] = whole.get(y, 0) + k
                waste = capacity - sum(y * k for y, k in whole.items())
                times = min(left[y] // k for y, k in whole.items())
                times = min(times, allowed // waste) if waste else times
                if times > once:
                    yield tuple(whole.items()), 1 if once else times

    stack = [branches()] if counts and fewest > bound else []
    seen = 0
    while stack and seen <= nodes + 4 * len(counts):
        seen += 1
        step = next(stack[-1], None)
        if step is None or used >= fewest:
            stack.pop()
            if path:
                apply(*path.pop(), -1)
            continue
        apply(*step, 1)
        path.append(step)
        if wasted > (fewest - 1) * capacity - total:  # no better than the incumbent, whatever follows
            apply(*path.pop(), -1)
        elif used * capacity - wasted == total:
            best, fewest = list(path), used
            if fewest <= bound:
                break
            apply(*path.pop(), -1)
        else:
            stack.append(branches())
    return best


def _placed(batches: Iterator[pa.RecordBatch], slots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for x in np.unique(length).tolist():
            own = np.flatnonzero(length == x)
            start, times, first, place = slots[x]
            i = np.searchsorted(start, rank[own], side="right") - 1
            nth, within = np.divmod(rank[own] - start[i], times[i])
            sequence[own], offset[own] = first[i] + nth, place[i] + within * x
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(sequence), pa.array(offset)], names=[*(n for n, _ in rest), "sequence_id", "offset"])


def packed(parts: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """pieces() with `sequence_id` (from 0) and `offset` in it, in as few sequences of the capacity as the search finds.

    Only the number of pieces of each length, at most `capacity` numbers, goes through the driver, which plans fillings
    for them. Pieces are numbered within their length in buckets of bounded size, so that a common length is no one
    task's; each filling takes a range of these numbers.
    """
    names = parts.columns
    parts = written(parts)
    sizes = parts.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.collect()}
    slots: dict[int, list[tuple[int, int, int, int]]] = {x: [] for x in counts}
    taken, first = dict.fromkeys(counts, 0), 0
    for filling, n in bin_completion(counts, capacity, nodes):
        offset = 0
        for x, times in filling:
            slots[x].append((taken[x], times, first, offset))
            taken[x] += n * times
            offset += x * times
        first += n
    table = {x: np.array(s, dtype=np.int64).T for x, s in slots.items()}

    buckets = F.broadcast(sizes.select(F.col("length").alias("of"), F.ceil(F.col("n") / PER_BUCKET).alias("buckets")))  # a row a length
    spread = parts.join(buckets, F.col("length") == F.col("of")).withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.col("buckets"))).drop("of", "buckets")
    before = Window.partitionBy("of").orderBy("in_bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = spread.groupBy(F.col("length").alias("of"), F.col("bucket").alias("in_bucket")).agg(F.count("*").alias("n"))
    starts = written(filled.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_id")) - 1
    ranked = spread.withColumn("within", within).join(small(starts), (F.col("length") == F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    ranked = ranked.select(*names, (F.col("earlier") + F.col("within")).alias("rank"))
    schema = ", ".join(f"`{n}` {k}" for n, k in parts.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, slots=table), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts) of packed() pieces with ids: each sequence's tokens, its documents, and where they begin."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    found = placed.groupBy("sequence_id").agg(parts.alias("x"))
    return found.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("starts"))
