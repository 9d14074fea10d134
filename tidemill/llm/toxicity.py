"""Toxicity categories by a classifier chain.

The chain predicts its categories one after the other.  Each link is a linear (logistic) model over the words of a text
and the beginnings of its words, and over the probabilities of the earlier categories.  For training, those earlier
probabilities are out-of-fold predictions, so that a link learns from probabilities as good as those it will get.

The chain is fitted on a bounded sample of labelled rows (``labelled`` at most, those whose keys hash lowest) and applied
to every whole text.

Defined results: a null or empty text has no features and gets each link's base rate; with fewer than two labelled rows,
or one value only, a category's probability is its rate among the sample (0 without rows); labels that are null or whose
document is missing don't count; a key that repeats among the labels counts with its greatest label; other columns are
not carried by ``predict`` and all kept by ``keep_clean``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cut import cut, drop
from tidemill.llm.held import let_go

#: Labelled rows in the sample, features of a link, and words that a worker remembers, at most.
LABELLED, FEATURES, KEPT = 8_000, 4_096, 100_000
#: Folds of the out-of-fold predictions, and lengths of word beginnings.
FOLDS, BEGINNINGS = 5, (4, 5, 6, 7)
#: Parts of the hashes, a power of two: the driver takes the sample's features one part at a time.
PARTS = 16
#: Cells that a step of the fit takes at once.
STEP = 1 << 18
#: A document is toxic from this probability on.
THRESHOLD = 0.35
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    return [xxhash.xxh3_64_intdigest(word)] + [xxhash.xxh3_64_intdigest(word[:n] + "*") for n in BEGINNINGS if len(word) > n]


def text_features(text: str | None) -> np.ndarray:
    """Distinct feature hashes of a text."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(np.fromiter((h for w in set(WORD.findall(text.lower())) for h in word_features(w)), np.uint64))


@dataclass
class Link:
    """One category's model: feature hashes to weights, weights of the earlier categories, and a bias."""

    weights: dict[int, float]
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    """Links by category, in order."""

    links: dict[str, Link]
    known: dict[str, list[tuple[int, float]]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"links": self.links, "known": {}}

    def predict(self, text: str | None) -> list[float]:
        """Probability of each category."""
        sums = [link.bias for link in self.links.values()]
        fired: dict[int, set[int]] = {}
        for word in set(WORD.findall(text.lower())) if text else ():
            hits = self.known.get(word)
            if hits is None:
                if len(self.known) >= KEPT:
                    self.known.clear()
                hashes = word_features(word)
                self.known[word] = hits = [(i, h) for i, link in enumerate(self.links.values()) for h in hashes if h in link.weights]
            for i, h in hits:
                fired.setdefault(i, set()).add(h)
        out: list[float] = []
        for i, link in enumerate(self.links.values()):
            total = sums[i] + sum(link.weights[h] for h in fired.get(i, ())) + sum(w * p for w, p in zip(link.earlier, out, strict=True))
            out.append(_sigmoid(total))
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(rows: np.ndarray, columns: np.ndarray, width: int, dense: np.ndarray, y: np.ndarray, rounds: int = 150, decay: float = 2e-4) -> np.ndarray:
    """Weights (sparse features, dense features, bias) by adaptive full gradient steps; rows and columns are the set cells."""
    weights = np.zeros(width + dense.shape[1] + 1)
    speed = np.full(len(weights), 1e-8)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weights[-1] = np.log(rate / (1 - rate))
    steps = [slice(i, i + STEP) for i in range(0, len(rows), STEP)]  # to hold little at once
    for _ in range(rounds):
        margin = sum((np.bincount(rows[s], weights[columns[s]], len(y)) for s in steps), np.zeros(len(y))) + dense @ weights[width:-1] + weights[-1]
        error = (_sigmoid(margin) - y) / len(y)
        telling = sum((np.bincount(columns[s], error[rows[s]], width) for s in steps), np.zeros(width))
        slope = np.concatenate([telling, dense.T @ error, [error.sum()]])
        slope[:-1] += decay * weights[:-1] / max(1, width) ** 0.5
        speed += slope**2
        weights -= 0.5 * slope / np.sqrt(speed)
    return weights


#: Cells of the texts' features by parts of the hashes: text and feature, both by place.
Cells = list[tuple[np.ndarray, np.ndarray]]


def _telling(cells: Cells, width: int, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The features that tell the two values apart best among the rows in use, by their log odds against their spread."""
    with_, without = np.zeros(width), np.zeros(width)
    for rows, codes in cells:
        if len(codes):
            low, high = int(codes.min()), int(codes.max()) + 1  # a part has features of its own
            with_[low:high] += np.bincount(codes - low, (y * use)[rows], high - low)
            without[low:high] += np.bincount(codes - low, ((1 - y) * use)[rows], high - low)
    positive, negative = max(1, (y * use).sum()), max(1, ((1 - y) * use).sum())
    odds = np.log((with_ + 0.5) / (positive + 1)) - np.log((without + 0.5) / (negative + 1))
    score = np.abs(odds) / np.sqrt(1 / (with_ + 0.5) + 1 / (without + 0.5))
    score[with_ + without < 3] = 0
    best = np.argsort(-score, kind="stable")[:FEATURES]
    return best[score[best] > 2.5]


def _parts(features: np.ndarray) -> list[np.ndarray]:
    """A text's hashes, in order, by their highest bits."""
    borders = np.arange(1, PARTS, dtype=np.uint64) << np.uint64(64 - PARTS.bit_length() + 1)
    return np.split(features, np.searchsorted(features, borders))


def fit_chain(features: list[np.ndarray], labels: dict[str, np.ndarray]) -> Chain:
    """The chain of these categories over these texts' features."""
    split = [_parts(f) for f in features]
    parts = ((np.concatenate([np.empty(0, np.uint64), *(f[p] for f in split)]), np.array([len(f[p]) for f in split], np.int64)) for p in range(PARTS))
    return _fitted(parts, len(features), labels)


def _fitted(parts: Iterable[tuple[np.ndarray, np.ndarray]], count: int, labels: dict[str, np.ndarray]) -> Chain:
    """The same for features that come part by part of the hashes, one text after the other, with how many each text has."""
    links: dict[str, Link] = {}
    cells: Cells = []
    names = [np.empty(0, np.uint64)]
    width = 0
    for flat, sizes in parts:  # one at a time, to hold little at once
        own, times = np.unique(flat, return_counts=True)
        own = own[times >= 3]  # rarer ones are never chosen
        if len(own):
            at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = own[at] == flat
            cells.append((np.repeat(np.arange(count, dtype=np.int32), sizes)[common], (at[common] + width).astype(np.int32)))
            names.append(own)
            width += len(own)
    hashes = np.concatenate(names)
    fold = np.arange(count) % FOLDS
    earlier = np.empty((count, 0))
    for name, y in labels.items():
        y = y.astype(float)
        if count < 2 or y.min() == y.max():
            rate = float(y.mean()) if count else 0.0
            links[name] = Link({}, np.zeros(earlier.shape[1]), float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))))
            earlier = np.column_stack([earlier, np.full(count, rate)])
            continue
        held = np.zeros(count)
        for part in [*range(FOLDS), -1]:  # the last model learns from all rows
            use = fold != part
            chosen = _telling(cells, width, y, use)
            at = np.full(width, -1, np.int32)
            at[chosen] = np.arange(len(chosen))
            set_ = [at[codes] >= 0 for _, codes in cells]
            rows = np.concatenate([np.empty(0, np.int32), *(r[s] for (r, _), s in zip(cells, set_, strict=True))])
            columns = np.concatenate([np.empty(0, np.int32), *(at[c[s]] for (_, c), s in zip(cells, set_, strict=True))])
            del set_
            own = use[rows]
            place = (np.cumsum(use) - 1).astype(np.int32)
            weights = _logistic(place[rows[own]], columns[own], len(chosen), earlier[use], y[use])
            if part >= 0:
                margin = sum((np.bincount(rows[i : i + STEP], weights[columns[i : i + STEP]], count) for i in range(0, len(rows), STEP)), np.zeros(count)) + earlier @ weights[len(chosen) : -1] + weights[-1]
                held[~use] = _sigmoid(margin)[~use]
        links[name] = Link({int(h): float(w) for h, w in zip(hashes[chosen], weights, strict=False)}, weights[len(chosen) : -1], float(weights[-1]))
        earlier = np.column_stack([earlier, held])
    return Chain(links)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], labelled: int = LABELLED, key: str = "doc_id", text: str = "text") -> Chain:
    """A chain fitted on ``labelled`` rows at most; ``categories`` are conditions over the label columns, in order."""
    names = list(categories)
    marks = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]).na.drop()
    marks = marks.groupBy("k").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))]).orderBy(F.xxhash64("k"), "k").limit(labelled)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(marks), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found = [_parts(text_features(x.as_py())) for x in batch.column(1)]
            lists = [pa.array([f[p].view(np.int64) for f in found], pa.list_(pa.int64())) for p in range(PARTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *batch.columns[2:]], schema.fieldNames())

    parts = [f"f{p}" for p in range(PARTS)]
    schema = T.StructType([rows.schema["k"], *(T.StructField(f, T.ArrayType(T.LongType())) for f in parts), *(T.StructField(f"y{i}", T.IntegerType()) for i in range(len(names)))])
    found = rows.mapInArrow(run, schema).withColumn("h", F.xxhash64(*parts))
    sample = cut(found.orderBy("k", "h").limit(labelled))  # bounded, however often a key repeats

    def ordered(*columns: str) -> pa.Table:
        return sample.coalesce(1).sortWithinPartitions("k", "h").select(*columns).toArrow()

    def taken() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for f in parts:
            lists = ordered(f).column(0).combine_chunks() if count else pa.array([], pa.list_(pa.int64()))
            yield lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    got = ordered(*(f"y{i}" for i in range(len(names))))
    count, values = got.num_rows, {n: got.column(f"y{i}").to_numpy() for i, n in enumerate(names)}
    chain = _fitted(taken(), count, values)
    drop(sample)
    return chain


def predict(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``p_<category>`` for every whole text."""
    names = [f"p_{n}" for n in chain.links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            rows = [chain.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names)))], [key, *names])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, T.StructType([docs.schema[key], *(T.StructField(n, T.DoubleType()) for n in names)]))


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose probability of the category is below the threshold."""
    at = list(chain.links).index(category)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            yield batch.filter(pa.array([chain.predict(x.as_py())[at] < threshold for x in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def production_categories() -> dict[str, Column]:
    """Categories of the ``labels`` table: junk writing, toxic writing, and both."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0)}
