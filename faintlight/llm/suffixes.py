"""Removal of byte strings that stood earlier, by a depth-limited radix sort of suffixes (operator 10).

Suffixes are told apart only down to the threshold, by passes from coarse to fine, each a shuffle that groups equal
digits and drops what is alone. A digit is a hash of a stretch of the suffix at a place that its own content chooses, so
that neighbouring suffixes share it and go through a pass as one row:

1. the digit is the anchor gram of a run of neighbouring suffixes (see repeats); of equal runs that meet in one task
   already only the earliest is sent;
2. within it, the run's whole content: equal runs are equal in all their suffixes, so later ones are done;
3. first runs that share their gram with other contents are split into blocks of eight suffixes, whose digit is all that
   the eight have in common down to the threshold;
4. blocks that share it with other contents are split into suffixes, whose last digit is all bytes down to the
   threshold. Equal groups are exactly the repeated windows.

Passes over the leading bytes of every suffix would send each byte of the corpus around several times as a row of its
own, far more than the disks here hold.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from faintlight.llm import repeats
from faintlight.llm.store import written

GRAM = 24


def _keep(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    raw = text.tobytes()
    pieces, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        pieces.append(raw[at:a])
        at = b
    pieces.append(raw[at:])
    return len(raw), int((ends - starts).sum()), len(starts), b"".join(pieces)


def _digest(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    *counts, kept = _keep(text, starts, ends)
    return *counts, hashlib.sha256(kept).hexdigest()


def _bytes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    return _keep(text, starts, ends)


def without_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100, gram: int = GRAM, digest: bool = False
) -> DataFrame:
    """Texts without the bytes covered by a string of `threshold` bytes that also starts earlier.

    Earlier is a smaller id, or the same row and a smaller start; overlapping strings count. Returns one row per input
    row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), and kept (the remaining bytes, which may cut
    through a character) or, with digest=True, kept_sha256. Null and empty texts have no bytes; shorter texts than the
    threshold stay whole; very long ones are judged by their runs like others and only held whole, one at a time, to be
    cut. Rows without an id are returned whole and make nothing else repeated. Rows that share an id
    are put in order by a checksum of their texts; equal rows don't shorten each other. Other columns are ignored.
    """
    texts = repeats.source(docs, id_col, text_col)
    earlier = lambda first, own: first < own
    runs = written(repeats.judged(repeats.runs(texts, "byte", threshold, gram), earlier))
    packed = repeats.packed(texts)
    parts = repeats.judged(repeats.blocks(runs.where("NOT covered"), packed, "byte", threshold, gram), earlier)
    single = repeats.repeated_windows(repeats.windows(parts.where("NOT covered"), packed, "byte", threshold), earlier)
    covered = runs.where("covered").drop("gram").union(parts.where("covered").drop("gram"))
    spans = repeats.spans_of(covered, single, threshold)
    last = "kept_sha256 string" if digest else "kept binary"
    cut = partial(repeats.cut, keep=_digest if digest else _bytes, names=["n_bytes", "n_removed", "n_spans", last.split()[0]])
    return packed.join(spans, repeats.KEY, "left").mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
