"""Language identification with segmentation-marginalised unigrams (operator 9).

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a language is the
sum over all ways to cut it into pieces, which a forward pass over the word's characters adds up; a text's is the
product over its words. Piece probabilities are fitted by expectation maximisation: how often a piece is expected in
all segmentations of a language's words, weighted by their probability.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlight.llm.store import written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 2000
ROUNDS = 4
LONGEST = 16
FLOOR = 1e-7
CACHE = 150_000
SLICE_ROWS = 256
UNKNOWN = "und"

#: Numerals such as one half or superscript two, which \w holds beside letters and \d doesn't.
_NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
_WORD = re.compile(r"[^\W\d_]+")
_NUMERAL = re.compile(f"[{_NUMERALS}]+")
#: Words of more letters take a pass of their own, with sums brought back into range on the way.
_SHORT = 32
#: So many letters of a long word are looked up in the trie at a time.
_STRETCH = 4096


def pieces(path: str = VOCABULARY) -> frozenset[str]:
    """The vocabulary's pieces of letters, lower-cased, without word marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size()))
    return frozenset(p for p in names if p and len(p) <= LONGEST and _WORD.fullmatch(p))


def words(text: str) -> list[str]:
    """The lower-cased runs of letters, whole however long they are."""
    found = _WORD.findall(text.lower())
    if not text.isascii() and not all(map(str.isalpha, found)):
        found = [part for word in found for part in _NUMERAL.split(word) if part]
    return found


class _Index(dict):
    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Segmenter:
    """Word probabilities in all languages at once, by a forward pass over many words side by side.

    The pieces form a trie, kept as sorted pairs of node and letter; node 0 stands for a letter that is no piece.
    Position by position of all words, and length by length of the pieces that start there, F(end) += F(start) * P(piece).
    """

    def __init__(self, pieces: list[str], weights: np.ndarray, unseen: float = FLOOR):
        letters = {c: i for i, c in enumerate(sorted({c for piece in pieces for c in piece}))}
        self.letters = np.array([*map(ord, letters)], dtype=np.uint32)
        nodes: dict[str, int] = {"": 1}
        for piece in pieces:
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes) + 1)
        self.width = len(letters) + 1
        pairs = sorted((nodes[p[:-1]] * self.width + letters[p[-1]], node) for p, node in nodes.items() if p)
        self.pairs, self.targets = np.array([(-1, 0), *pairs], dtype=np.int64).T.copy()
        self.nodes = np.array([nodes[piece] for piece in pieces], dtype=np.int64)
        self.weights = np.zeros((len(nodes) + 1, weights.shape[1]))
        self.weights[self.nodes] = weights
        self.weights[0] = unseen
        self.ends = np.zeros(len(nodes) + 1, dtype=bool)
        self.ends[self.nodes] = True

    def _step(self, node: np.ndarray | int, letter: np.ndarray) -> np.ndarray:
        """The nodes that letters lead to from nodes; 0 where there is none."""
        pair = node * self.width + letter
        place = np.searchsorted(self.pairs, pair, side="right") - 1
        return np.where(self.pairs[place] == pair, self.targets[place], 0)

    def _letters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = np.searchsorted(self.letters, points)
        known = letter < len(self.letters)
        known[known] = self.letters[letter[known]] == points[known]
        letter[~known] = len(self.letters)
        return letter

    def arcs(self, words: list[str], size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, words, nodes) of all pieces in words, which are sorted from long to short, by start."""
        letter, first = self._letters("".join(words)), np.cumsum(size) - size
        for at in range(int(size.max(initial=0))):
            live = np.arange(np.searchsorted(-size, -at, side="left"))  # the words that are longer than `at`
            node = self._step(1, letter[first[live] + at])
            alone = ~self.ends[node]
            yield at, 1, live[alone], np.zeros(int(alone.sum()), dtype=np.int64)
            length = 1
            while len(live):
                whole = self.ends[node]
                yield at, length, live[whole], node[whole]
                further = (node > 0) & (size[live] > at + length)
                live, node = live[further], node[further]
                node = self._step(node, letter[first[live] + at + length])
                live, node = live[node > 0], node[node > 0]
                length += 1

    def logs(self, words: list[str]) -> np.ndarray:
        """The words' log probabilities, one row a word."""
        out = np.zeros((len(words), self.weights.shape[1]))
        long = [i for i, w in enumerate(words) if len(w) > _SHORT]
        for i in long:
            out[i] = self._long(words[i])
        order = np.array(sorted((i for i, w in enumerate(words) if len(w) <= _SHORT), key=lambda i: -len(words[i])), dtype=np.int64)
        size = np.array([len(words[i]) for i in order], dtype=np.int64)
        sums = np.zeros((int(size.max(initial=0)) + 1, len(order), out.shape[1]))
        sums[0] = 1.0
        for at, length, live, node in self.arcs([words[i] for i in order], size):
            sums[at + length, live] += sums[at, live] * self.weights[node]
        out[order] = np.log(sums[size, np.arange(len(order))])
        return out

    def _long(self, word: str) -> np.ndarray:
        """The log probabilities of one word of any length."""
        letter, n_languages = self._letters(word), self.weights.shape[1]
        log, sums = np.zeros(n_languages), np.zeros((LONGEST + _STRETCH, n_languages))
        sums[LONGEST - 1] = 1.0  # row LONGEST + i holds the sum up to and with letter i of the stretch
        for base in range(0, len(letter), _STRETCH):
            end = min(len(letter), base + _STRETCH)
            ending = np.zeros((end - base, LONGEST, n_languages))  # the pieces that end at a letter, long ones first
            start = np.arange(max(0, base - LONGEST + 1), end)
            node = self._step(1, letter[start])
            for length in range(1, LONGEST + 1):
                taken = self.ends[node] | (length == 1)
                last = start[taken] + length - 1
                here = last >= base
                ending[last[here] - base, LONGEST - length] = self.weights[np.where(self.ends[node[taken]], node[taken], 0)[here]]
                further = (node > 0) & (start + length < end)
                start, node = start[further], node[further]
                node = self._step(node, letter[start + length])
            for i in range(end - base):
                sums[LONGEST + i] = total = (sums[i : i + LONGEST] * ending[i]).sum(axis=0)
                if total.min() < 1e-100 or total.max() > 1e100:
                    sums[i + 1 : i + 1 + LONGEST] /= total
                    log += np.log(total)
            sums[:LONGEST] = sums[end - base : end - base + LONGEST].copy()
        return log + np.log(sums[LONGEST - 1])

    def expected(self, words: list[str], times: np.ndarray, language: np.ndarray) -> np.ndarray:
        """How often each piece (row) is expected in each language (column), in the words' segmentations."""
        order = np.array(sorted(range(len(words)), key=lambda i: -len(words[i])), dtype=np.int64)
        size, own = np.array([len(words[i]) for i in order], dtype=np.int64), language[order]
        steps = [(at, at + length, live, node, self.weights[node, own[live]]) for at, length, live, node in self.arcs([words[i] for i in order], size)]
        ahead = np.zeros((int(size.max(initial=0)) + 1, len(order)))
        back, all_ = np.zeros_like(ahead), np.arange(len(order))
        ahead[0], back[size, all_] = 1.0, 1.0
        for start, end, live, _, p in steps:
            ahead[end, live] += ahead[start, live] * p
        for start, end, live, _, p in reversed(steps):
            back[start, live] += back[end, live] * p
        share, out = times[order] / ahead[size, all_], np.zeros_like(self.weights)
        for start, end, live, node, p in steps:
            np.add.at(out, (node, own[live]), share[live] * ahead[start, live] * p * back[end, live])
        return out[self.nodes]


def _expectations(batches: Iterator[pa.RecordBatch], names: list[str], weights: np.ndarray, languages: list[str]) -> Iterator[pa.RecordBatch]:
    """(language, piece, n) from (lang, word, n)."""
    segmenter, place = Segmenter(names, weights), {x: i for i, x in enumerate(languages)}
    total = np.zeros(weights.shape)
    for whole in batches:
        for start in range(0, whole.num_rows, 5000):
            lang, found, times = (c.to_pylist() for c in whole.slice(start, 5000).select(["lang", "word", "n"]).columns)
            parts = [(w[i : i + _SHORT], n, place[x]) for x, w, n in zip(lang, found, times, strict=True) for i in range(0, len(w), _SHORT)]
            own, n, language = zip(*parts, strict=True)
            total += segmenter.expected(list(own), np.array(n, dtype=float), np.array(language))
    piece, language = total.nonzero()
    yield pa.RecordBatch.from_arrays(
        [pa.array(language.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, language])], names=["language", "piece", "n"]
    )


def fit(counted: DataFrame, languages: list[str], vocabulary: frozenset[str], rounds: int = ROUNDS) -> dict:
    """The model from counted words (lang, word, n): {"languages", "pieces", "weights" (by piece and language)}.

    Each round of expectation maximisation is a Spark job over all words, from which only sums by language and piece
    reach the driver: at most as many as the vocabulary holds for each language. Pieces start with equal probabilities.
    Here words of more than _SHORT letters count in parts; the model scores them whole.
    """
    names = sorted(vocabulary)
    weights = np.full((len(names), len(languages)), 1.0 / max(1, len(names)))
    for _ in range(rounds if languages else 0):
        found = counted.mapInArrow(partial(_expectations, names=names, weights=weights, languages=languages), "language int, piece int, n double")
        # Rounded, so that the order in which partial sums meet decides nothing.
        sums = found.groupBy("language", "piece").agg(F.round(F.sum("n"), 6).alias("n")).toPandas()
        weights = np.zeros(weights.shape)
        weights[sums["piece"], sums["language"]] = sums["n"]
        weights = weights / np.maximum(weights.sum(axis=0), 1e-6) + FLOOR
    used = (weights > 2 * FLOOR).any(axis=1)
    return {"languages": languages, "pieces": [x for x, u in zip(names, used, strict=True) if u], "weights": weights[used]}


def _posteriors(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    languages = model["languages"]
    segmenter = Segmenter(model["pieces"], model["weights"])
    index = _Index()
    logs = np.zeros((0, len(languages)))
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(start, SLICE_ROWS)
            if len(index) > CACHE:
                index, logs = _Index(), logs[:0]
            found = [[*map(index.__getitem__, words(text or ""))] for text in batch.column("text").to_pylist()]
            new = list(index)[len(logs) :]
            logs = np.concatenate([logs, segmenter.logs(new)]) if new else logs
            predicted, scores = [], []
            for ids in found:
                if not ids or not languages:
                    predicted.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = logs[ids].sum(axis=0)
                share = np.exp(total - total.max())
                predicted.append(languages[int(share.argmax())])
                scores.append(float(1.0 / share.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["text"]).columns, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                names=[*(n for n in batch.schema.names if n != "text"), "lang_pred", "score"],
            )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter((lang.as_py(), w) for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True) for w in words(text.as_py() or ""))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["lang", "word", "n"],
        )


def learned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, vocabulary: str = VOCABULARY,
) -> dict:
    """A model from rows with text and language: all words of at most `sample_docs` documents of each language, chosen by
    a hash of the id. Repeated rows count as often as they stand there; without any such row the model knows no
    language. Very long texts count whole."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang")
    )
    languages = rows.groupBy("lang").agg(F.count("*").alias("of"))
    # Shares of the hash range that hold a little under sample_docs rows of each language.
    bounds = {r["lang"]: min(1.0, sample_docs / r["of"]) for r in languages.collect()}
    within = F.lit(False)
    hashed = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    for lang, share in bounds.items():
        within = within | ((F.col(lang_col) == lang) & (hashed < share))
    sample = docs.where(F.col(text_col).isNotNull() & within).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return fit(written(counted), sorted(bounds), pieces(vocabulary))


def identified(docs: DataFrame, model: dict, text_col: str = "text", keep: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score, the posterior probability of lang_pred for equal priors.

    Whole texts are read. A text that is null or has no letter is "und" with score 0, as is every text if the model
    knows no language. Equal probabilities go to the first language by name. Repeated rows and rows without an id are
    predicted like others; empty tables stay empty.
    """
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(partial(_posteriors, model=model), f"{schema}, lang_pred string, score double")
