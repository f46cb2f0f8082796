"""Vectorised views of a batch of texts: words, rolling hashes, windows and their anchors.

Everything works on the UTF-8 bytes of an Arrow string column, a few hundred kilobytes at a time, so that memory does
not grow with a partition, only with the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
CHUNK_ROWS = 1000
LONG_WORD = 32
#: Bytes that separate words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_MULTIPLIER = 0xD1342543DE82EF95
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words after which every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        grown = []
        for base in (_MULTIPLIER, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            grown.append(np.cumprod(steps))
        _powers = tuple(grown)
    return _powers


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which span_hash() takes the hash of any span of codes."""
    up, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal spans have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class Texts:
    """Some consecutive rows of a string column as bytes; row r holds data[offsets[r]:offsets[r + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, r: int) -> np.ndarray:
        return self.data[self.offsets[r] : self.offsets[r + 1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each row the place of its first word (one entry more than rows)."""
        inside = ~SPACE[self.data]
        begins, finishes = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finishes[:-1] &= ~inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        firsts, lasts = self.offsets[:-1][full], self.offsets[1:][full] - 1
        begins[firsts], finishes[lasts] = inside[firsts], inside[lasts]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_codes(self, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A 64-bit code for each word, with what words() returns.

        Sums of codes times powers modulo 2**64 tell long words of a certain structure badly apart, so words of more than
        LONG_WORD bytes have a digest for their code."""
        starts, ends, places = self.words()
        data = LOWER[self.data] if lower else self.data
        codes = span_hash(prefix_sums(BYTE_CODES[data]), starts, ends)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        digests = (blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        codes[long] = np.frombuffer(b"".join(digests), dtype="<u8")
        return codes, starts, ends, places


def chunks(column: pa.Array, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[Texts]:
    """The column in runs of rows of limited size; a text longer than that has a run to itself. Nulls read as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), i + rows, len(column))
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def rows_of(places: np.ndarray) -> np.ndarray:
    """The row of each item, where row r holds the items places[r] to places[r + 1]."""
    return np.repeat(np.arange(len(places) - 1), np.diff(places))


def shingle_sets(texts: Texts, width: int) -> list[np.ndarray]:
    """For each row its distinct shingles of lower-cased words as sorted hashes.

    A row with fewer words than width has its whole sequence as one shingle, a row without words has none.
    """
    codes, _, _, places = texts.word_codes(lower=True)
    sums = prefix_sums(codes)
    sets = []
    for a, b in zip(places[:-1], places[1:], strict=True):
        at = np.arange(a, max(b - width, a) + 1) if b > a else np.arange(0)
        sets.append(np.unique(span_hash(sums, at, np.minimum(at + width, b))))
    return sets


def anchors(codes: np.ndarray, places: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Content-chosen anchors, one or more in every window of so many units.

    Among the grams of a window the one with the smallest hash is its anchor (the leftmost of equal ones). Windows with
    equal content so have their anchor at the same place, wherever they stand. Neighbouring windows mostly share their
    anchor: each result entry is one anchor with the run of window starts low..high (counted from the row's first unit)
    that chose it. "gram" is the hash of the anchor's gram, "run" the hash of all units under the run's windows
    together with the anchor's place in it, "row" the row.
    """
    size = np.diff(places)
    sums = prefix_sums(codes)
    span = window - gram + 1
    n_grams = len(codes) - gram + 1
    if n_grams < span or not (size >= window).any():
        none = np.zeros(0, dtype=np.int64)
        return {"row": none, "low": none, "high": none, "gram": none.astype(np.uint64), "run": none.astype(np.uint64)}
    at = np.arange(n_grams)
    hashes = span_hash(sums, at, at + gram)
    bits = np.uint64(max(len(codes).bit_length(), 20))
    best = ((hashes >> bits) << bits) | at.astype(np.uint64)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        best = np.minimum(best[: len(best) - step], best[step:])
        reach += step
    best &= (np.uint64(1) << bits) - np.uint64(1)
    chosen = best.astype(np.int64)
    starts = np.arange(len(chosen))
    row = rows_of(places)[: len(chosen)]
    whole = starts + window <= places[row + 1]
    starts, chosen, row = starts[whole], chosen[whole], row[whole]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high, anchor, row = starts[first], starts[last], chosen[first], row[first]
    run = mix(span_hash(sums, low, high + window) + (anchor - low).astype(np.uint64))
    return {"row": row, "low": low - places[row], "high": high - places[row], "gram": hashes[anchor], "run": run}
