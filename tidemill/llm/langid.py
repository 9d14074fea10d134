"""Language identification of words and documents by a linear-chain conditional random field.

Each word of a text gets a score for each language from its features (the word itself as a lexicon entry, affixes,
letter n-grams, all hashed) and each pair of neighbouring words a learned transition; the forward-backward algorithm
turns them into the probability of each language for each word, over the whole text as one chain.  A document's language
is the one with the greatest mean probability.

Documents carry one label only, so code-switched training chains are spliced from runs of words of differently labelled
documents: they teach both the features and how seldom the language changes.  The field is fitted by stochastic gradient
steps on its likelihood, on a bounded sample (``docs_each`` documents for each language, those whose keys hash lowest;
repeated rows count once).

Defined results: ``und`` with score 0 for a text that is null or has no letters, or if nothing could be learned; of equal
probabilities the language first in order; repeated rows give repeated rows; ``predict`` carries the key alone,
``keep_identified`` all columns.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.held import held

#: Documents of each language in the sample, and words that a worker remembers, at most.
DOCS_EACH, KEPT = 150, 200_000
#: Hashed features, training chains of a step and words of a chain, steps, and words from which on a task labels what it has.
BUCKETS, CHAINS, LENGTH, STEPS, TOGETHER = 1 << 17, 48, 60, 260, 400_000
#: Features of new words that are summed up at once.
CELLS = 200_000
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
_RUNS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """Runs of letters of a text."""
    found = _RUNS(text) if text else []
    return found if all(map(str.isalpha, found)) else LETTERS.findall(text)  # the quick pattern also takes numerals such as ²


class _Buckets(dict):
    """Feature to its bucket; short features, which most words share, are remembered."""

    def __missing__(self, feature: str) -> int:
        bucket = xxhash.xxh32_intdigest(feature) % BUCKETS
        if len(self) < KEPT:
            self[feature] = bucket
        return bucket



def _buckets() -> _Buckets:
    return held("langid", _Buckets)


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, prefixes, suffixes and letter n-grams of its lower-case form."""
    w = word.lower()
    marked = f"<{w}>"
    size = len(marked)
    found = [marked[i : i + 2] for i in range(size - 1)] + [marked[i : i + 3] for i in range(size - 2)]
    found += ["p" + w[:1], "p" + w[:2], "p" + w[:3], "s" + w[-1:], "s" + w[-2:], "s" + w[-3:]]
    return [*map(_buckets().__getitem__, dict.fromkeys(found)), xxhash.xxh32_intdigest(f"={w}") % BUCKETS]


class _Rows(dict):
    """Word to the place of its scores, which are computed for many new words at once."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.table, self.done = weights, np.empty((1024, weights.shape[1]), np.float32), 0
        self.cells: list[int] = []
        self.starts: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.starts.append(len(self.cells))
        self.cells += features(word)
        if len(self.cells) >= CELLS:
            self.fill()
        return place

    def fill(self) -> None:
        """Scores of the words met since the last time."""
        if self.starts:
            while len(self) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.done : len(self)] = np.add.reduceat(self.weights[self.cells], self.starts, axis=0)
            self.done, self.cells, self.starts = len(self), [], []


def _mixed(step: np.ndarray, now: np.ndarray) -> np.ndarray:
    """``step.T @ now``, added in one order whatever the number of columns, so that a chain's result doesn't hang on the others."""
    out = step[0][:, None] * now[0]
    for own, row in zip(step[1:], now[1:], strict=True):
        out += own[:, None] * row
    return out


def _normal(rows: np.ndarray) -> np.ndarray:
    """Columns that sum to 1, in place."""
    total = rows[0].copy()
    for row in rows[1:]:
        total += row
    rows /= total
    return rows


@dataclass
class Field:
    """Languages, feature weights (buckets x languages) and transitions (from x to)."""

    langs: list[str]
    weights: np.ndarray
    moves: np.ndarray
    known: _Rows | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "weights": self.weights, "moves": self.moves, "known": None}

    def scores(self, found: list[list[str]], total: int) -> np.ndarray:
        """Scores (words x languages) of texts one after the other; a distinct word is looked at once while it is remembered."""
        if self.known is None or len(self.known) > KEPT:
            self.known = _Rows(self.weights)
        at = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(found)), np.int64, total)
        self.known.fill()
        return self.known.table[at]

    def probabilities(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward over chains that lie one after the other in ``scores``: a row of probabilities for each word."""
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        ends = np.cumsum(sizes)
        longest = int(sizes.max(initial=0))
        active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")  # chains longer than t
        first = np.cumsum(active) - active
        # all first words, longest chain first, then all second words, and so on: each step works on one slice
        place = first[np.arange(len(scores)) - np.repeat(ends - sizes, sizes)] + np.repeat(rank, sizes)
        local = np.empty(scores.shape[::-1], np.float32)
        local[:, place] = np.exp(scores - scores.max(axis=1, keepdims=True)).T
        step = np.exp(self.moves - self.moves.max()).astype(np.float32)
        forward = np.empty_like(local)
        now = None
        for a, n in zip(first.tolist(), active.tolist(), strict=True):
            here = local[:, a : a + n]
            now = _normal(here.copy() if now is None else _mixed(step, now[:, :n]) * here)
            forward[:, a : a + n] = now
        back = np.ones((len(self.langs), len(sizes)), np.float32)
        turned = np.ascontiguousarray(step.T)
        for t in range(longest - 2, -1, -1):
            a, n = int(first[t + 1]), int(active[t + 1])
            back[:, :n] = _normal(_mixed(turned, back[:, :n] * local[:, a : a + n]))
            forward[:, first[t] : first[t] + n] *= back[:, :n]
        return np.ascontiguousarray(_normal(forward)[:, place].T)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and the runs of words of one language (start, end, language), of each text; see ``predict``."""
        places = [[m.span() for m in LETTERS.finditer(x or "")] for x in texts]
        found = [[x[a:b] for a, b in own] for x, own in zip(texts, places, strict=True)]
        out = self.languages(found)
        runs = []
        for spans, words, probabilities in zip(places, found, out[2], strict=True):
            best = probabilities.argmax(axis=1) if len(words) else []
            own: list[tuple[int, int, str]] = []
            for (a, b), i in zip(spans, best, strict=True):
                if own and own[-1][2] == self.langs[i]:
                    own[-1] = (own[-1][0], b, self.langs[i])
                else:
                    own.append((a, b, self.langs[i]))
            runs.append(own)
        return list(zip(out[0], out[1], runs, strict=True))

    def languages(self, found: list[list[str]]) -> tuple[list[str], list[float], list[np.ndarray]]:
        """Language, score, and the probabilities of each word, of texts given as lists of words."""
        sizes = np.array([len(w) for w in found])
        nothing = np.empty((0, len(self.langs)), np.float32)
        if not self.langs or not sizes.sum():
            return [UNKNOWN] * len(found), [0.0] * len(found), [nothing] * len(found)
        each = self.probabilities(self.scores(found, int(sizes.sum())), sizes)
        ends = np.cumsum(sizes)
        parts = [each[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        sums = np.add.reduceat(each, (ends - sizes)[sizes > 0], axis=0, dtype=np.float64)
        at = np.cumsum(sizes > 0) - 1
        means = [sums[k] / n if n else None for k, n in zip(at, sizes, strict=True)]
        best = [int(m.argmax()) if m is not None else -1 for m in means]
        return (
            [self.langs[i] if i >= 0 else UNKNOWN for i in best],
            [min(1.0, float(m[i])) if i >= 0 else 0.0 for m, i in zip(means, best, strict=True)],
            parts,
        )


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 0) -> Field:
    """A field fitted on labelled texts."""
    langs = sorted(set(labels))
    lists: dict[str, list[list[str]]] = {lang: [] for lang in langs}
    for text, lang in zip(texts, labels, strict=True):
        if words := words_of(text):
            lists[lang].append(words)
    langs = [lang for lang in langs if lists[lang]]
    count = len(langs)
    weights, moves = np.zeros((BUCKETS, count)), np.zeros((count, count))
    if count < 2:
        return Field(langs, weights.astype(np.float32), moves.astype(np.float32))
    rng = np.random.default_rng(seed)
    known: dict[str, np.ndarray] = {}
    fast, fast_moves = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(steps):
        chains, truth = [], []
        for _ in range(CHAINS):
            words: list[str] = []
            own: list[int] = []
            while len(words) < LENGTH:
                k = int(rng.integers(count))
                source = lists[langs[k]][int(rng.integers(len(lists[langs[k]])))]
                run = LENGTH if rng.random() < 0.5 else int(rng.integers(5, 30))
                start = int(rng.integers(max(1, len(source) - run + 1)))
                piece = source[start : start + run]
                words += piece
                own += [k] * len(piece)
            chains.append(words[:LENGTH])
            truth.append(own[:LENGTH])
        flat = [w for c in chains for w in c]
        distinct = sorted(set(flat))
        for w in distinct:
            if w not in known:
                known[w] = np.array(features(w))
        place = {w: i for i, w in enumerate(distinct)}
        at = np.array([place[w] for w in flat])
        cells = np.concatenate([known[w] for w in distinct])
        owner = np.repeat(np.arange(len(distinct)), [len(known[w]) for w in distinct])
        starts = np.concatenate([[0], np.cumsum([len(known[w]) for w in distinct])])[:-1]
        local = np.add.reduceat(weights[cells], starts, axis=0)[at].reshape(CHAINS, LENGTH, count)
        y = np.array(truth)
        # forward and backward in probabilities, each step normalised
        emit, step = np.exp(local - local.max(axis=2, keepdims=True)), np.exp(moves - moves.max())
        ahead, behind = np.empty_like(emit), np.ones_like(emit)
        for t in range(LENGTH):
            ahead[:, t] = emit[:, t] if t == 0 else (ahead[:, t - 1] @ step) * emit[:, t]
            ahead[:, t] /= ahead[:, t].sum(axis=1, keepdims=True)
        for t in range(LENGTH - 2, -1, -1):
            behind[:, t] = (behind[:, t + 1] * emit[:, t + 1]) @ step.T
            behind[:, t] /= behind[:, t].sum(axis=1, keepdims=True)
        node = ahead * behind
        node /= node.sum(axis=2, keepdims=True)
        edge = ahead[:, :-1, :, None] * step * (emit[:, 1:] * behind[:, 1:])[:, :, None, :]
        edge /= edge.sum(axis=(2, 3), keepdims=True)
        error = node.copy()
        error[np.arange(CHAINS)[:, None], np.arange(LENGTH), y] -= 1
        error = error.reshape(-1, count)
        of_word = np.stack([np.bincount(at, error[:, k], len(distinct)) for k in range(count)], axis=1)
        slope_moves = edge.sum(axis=(0, 1))
        np.subtract.at(slope_moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        touched, inverse = np.unique(cells, return_inverse=True)
        slope = np.stack([np.bincount(inverse, of_word[owner, k], len(touched)) for k in range(count)], axis=1) + 1e-3 * weights[touched]
        fast[touched] += slope**2
        weights[touched] -= 0.25 * slope / np.sqrt(fast[touched])
        fast_moves += slope_moves**2
        moves -= 0.25 * slope_moves / np.sqrt(fast_moves)
    return Field(langs, weights.astype(np.float32), moves.astype(np.float32))


def fit(docs: DataFrame, docs_each: int = DOCS_EACH, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Field:
    """A field fitted on ``docs_each`` documents of each language at most."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k", "h")
    chosen = rows.select("k", "lang", "h").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_each).drop("n")
    own = rows.join(F.broadcast(chosen), ["k", "lang", "h"]).dropDuplicates(["k", "lang", "h"])  # a repeated row comes once
    got = own.toArrow().sort_by([("lang", "ascending"), ("k", "ascending"), ("h", "ascending")])
    return train(got.column("t").to_pylist(), got.column("lang").to_pylist())


def _labelled(batch: pa.RecordBatch, place: int, model: Field) -> tuple[list[str], list[float]]:
    """Languages and scores of a batch, a step of texts of about ``TOGETHER`` words after the other, however long they are."""
    langs: list[str] = []
    scores: list[float] = []
    found: list[list[str]] = []
    total = 0
    for i, text in enumerate(batch.column(place)):
        found.append(words_of(text.as_py()))
        total += len(found[-1])
        if total >= TOGETHER or i == batch.num_rows - 1:
            own = model.languages(found)
            langs += own[0]
            scores += own[1]
            found, total = [], 0
    return langs, scores


def predict(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, ``lang_pred`` and ``score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _labelled(batch, 1, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def segments(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, language and score of every whole text, and its runs of words of one language (code points, end exclusive)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = model.label(batch.column(1).to_pylist())
            runs = [[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows]
            columns = [batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(runs, kind)]
            yield pa.RecordBatch.from_arrays(columns, [key, "lang_pred", "score", "segments"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
    schema = T.StructType([docs.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("segments", spans)])
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Field, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is known with this score or more."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _labelled(batch, place, model)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
