"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Several rotations are learned on a bounded sample (each from another start, by alternating sign codes and orthogonal
Procrustes steps), and a vector's code is the signs of its components under all of them: ``BITS`` bits or a few more, so
that the distance of codes tells the angle well.  Codes split into m substrings of 16 bits, each with an index from value
to rows.  For a radius r = m q + a, a code within r of the query's has one of its first a + 1 substrings within q or one
of the others within q - 1 (pigeonhole): probing the values of these balls retrieves all codes within r.  A ball's values
are listed one by one, or the values that occur are compared with the query's where that is less work.  What is retrieved
and lies within r is reranked by the original vectors.

The radius is learned on all rows: for ``ASKED`` of the queries the exact neighbours in the whole table are found, and the
radius is what holds ``HELD`` of them.  ``report`` gives the recall on those queries and the share of rows reranked.

Every row is indexed; rows are dealt to parts of bounded size, and the stated queries visit every part.  A query finds
fewer than k rows of a part within the radius only where fewer lie there; if it finds fewer than k, it grows the radius,
so it returns k rows whenever there are k candidates.

Defined results: see ``vectors.clean`` for the rows that take part (not null, finite, not zero, of the commonest
length); equal scores go by key; repeated keys count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import vectors
from tidemill.llm.cut import cut, drop

#: Rows that the rotations are fitted on, queries for the radius, and rows of an index part, at most.
FITTED, ASKED, PART = 4_096, 128, 65_536
#: Listing a value of a ball and its rows takes as long as comparing so many values.
LISTED = 16
#: Bits of a code at least, and the share of true neighbours of the asked queries within the radius.
BITS, HELD = 512, 0.93


@dataclass(frozen=True)
class Codes:
    """The fitted codes: vectors are centred, rotated, and cut to their signs."""

    centre: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    radius: int

    @property
    def substrings(self) -> int:
        """How many parts a code has."""
        return -(-self.rotation.shape[1] // 16)

    def of(self, rows: np.ndarray) -> np.ndarray:
        """Codes as one 16-bit word a substring; missing last bits are zero."""
        bits = (rows - self.centre) @ self.rotation > 0
        bits = np.pad(bits, ((0, 0), (0, self.substrings * 16 - bits.shape[1])))
        return np.packbits(bits, axis=1).view(np.uint16)


def fit(rows: np.ndarray, rounds: int = 25, bits: int = BITS) -> Codes:
    """Codes learned on a sample; the radius is still all bits."""
    dim = rows.shape[1]
    centre = rows.mean(axis=0)
    turned = rows - centre
    found = []
    for seed in range(-(-bits // dim)):
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(turned @ rotation > 0, 1.0, -1.0).T @ turned)
            rotation = (left @ right).T
        found.append(rotation)
    rotation = np.concatenate(found, axis=1)
    return Codes(centre, rotation, rotation.shape[1])


@lru_cache(maxsize=1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit masks by the number of their bits, and how many have q bits or fewer."""
    every = np.arange(1 << 16).astype(np.uint16)
    ones = np.bitwise_count(every)
    return every[np.argsort(ones, kind="stable")], np.cumsum(np.bincount(ones, minlength=17))


class MultiIndex:
    """Substring indexes over the codes of some rows: each from a value to the rows that have it."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        wide = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))
        self.wide = np.ascontiguousarray(np.ascontiguousarray(wide).view(np.uint64).T)  # four substrings a word, a row of rows each
        self.lists = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            starts = np.searchsorted(column[order], np.arange((1 << 16) + 1))
            values, which = np.unique(column, return_inverse=True)
            self.lists.append((order, values, starts, which))

    def retrieved(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that the probed balls hold: all codes within the radius are among them."""
        seen = np.zeros(len(self.codes), bool)
        reach, more = divmod(radius, len(self.lists))
        masks, upto = _masks()
        for place, (word, (order, values, starts, which)) in enumerate(zip(code, self.lists, strict=True)):
            own = min(16, reach if place <= more else reach - 1)
            if own < 0:
                continue
            if upto[own] * LISTED >= len(values):  # a value's rows are marked with it, without a list of them
                seen |= (np.bitwise_count(values ^ word) <= own)[which]
                continue
            ball = word ^ masks[: upto[own]]
            first, count = starts[ball], starts[ball.astype(np.int64) + 1] - starts[ball]
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            seen[order[at]] = True
        return np.flatnonzero(seen)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius."""
        rows = self.retrieved(code, radius)
        apart = np.zeros(len(rows), np.uint16)
        for own, word in zip(self.wide, np.pad(code, (0, -len(code) % 4)).view(np.uint64), strict=True):
            apart += np.bitwise_count(own[rows] ^ word)
        return rows[apart <= radius]


def _exact(rows: np.ndarray, ids: np.ndarray, query: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[int, float]]:
    """The k best of some rows and their scores."""
    rough = rows[at] @ query
    if len(at) > k:
        at = at[rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
    exact = (rows[at] * query).sum(axis=1)  # one order of addition, so that equal vectors tie
    for i in np.lexsort((ids[at], -exact))[:k]:
        yield int(ids[at[i]]), float(exact[i])


def _kernel(codes: Codes, k: int) -> vectors.Kernel:
    def build(ids: np.ndarray, rows: np.ndarray, _: np.ndarray):
        index = MultiIndex(codes.of(rows))
        bits = codes.rotation.shape[1]

        def find(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int, float]]:
            for q, query, code, need in zip(query_ids, queries, codes.of(queries), least, strict=True):
                radius = codes.radius
                near = index.within(code, radius)
                while len(near) <= need and radius < bits:  # one of them may be the query's own row
                    radius = min(bits, radius + 4)
                    near = index.within(code, radius)
                yield from ((int(q), v, score) for v, score in _exact(rows, ids, query, near[ids[near] != q], k))

        return find

    return build


def true_neighbours(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``, exact, of some queries (of bounded number) among all rows."""
    got = asked.select("id", "vec").toArrow()
    ids, queries = got.column("id").to_numpy(), vectors.matrix(got.column("vec").combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, float]]] = {}
        for batch in batches:
            own, data = batch.column(0).to_numpy(), vectors.matrix(batch.column(1))
            for q, query in zip(ids.tolist(), queries, strict=True) if len(own) else ():
                both = [*best.get(q, ()), *_exact(data, own, query, np.flatnonzero(own != q), k)]
                best[q] = sorted(both, key=lambda x: (-x[1], x[0]))[:k]
        found = [(q, v, s) for q, own in best.items() for v, s in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return vectors.best(rows.select("id", "vec").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def _fitted(rows: DataFrame, k: int, every: int) -> tuple[Codes, DataFrame]:
    """Codes with the radius that holds ``HELD`` of the asked queries' true neighbours, and those neighbours."""
    sample = vectors.sample(rows, FITTED)
    asked = rows.where(F.col("id") % every == 0).orderBy(F.xxhash64("id"), "id").limit(ASKED)
    true = cut(true_neighbours(rows, asked, k))
    if not len(sample):
        return Codes(np.zeros(1), np.eye(1), 1), true
    codes = fit(sample)
    both = true.join(rows.select(F.col("id").alias("query_id"), F.col("vec").alias("q")), "query_id").join(rows.select(F.col("id").alias("vec_id"), F.col("vec").alias("v")), "vec_id")
    pairs = both.select("q", "v").toArrow()  # ASKED x k at most
    if not pairs.num_rows:
        return codes, true
    one, two = (codes.of(vectors.matrix(pairs.column(c).combine_chunks())) for c in ("q", "v"))
    return replace(codes, radius=int(np.ceil(np.quantile(np.bitwise_count(one ^ two).sum(axis=1), HELD)))), true


def report(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> dict[str, float]:
    """Recall of ``nearest`` on ``ASKED`` queries, and the shares of rows that a query retrieves and reranks."""
    rows = cut(vectors.clean(table, key, vector, nonzero=True))
    codes, true = _fitted(rows, k, every)
    got = nearest(table, k, every, key, vector).select("query_id", "vec_id")
    hits = true.join(got, ["query_id", "vec_id"], "left_semi").count()
    some = vectors.matrix(rows.join(true.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi").select("vec").toArrow().column("vec").combine_chunks())
    index = MultiIndex(codes.of(vectors.sample(rows, PART)))
    found = [(len(index.retrieved(c, codes.radius)), len(index.within(c, codes.radius))) for c in codes.of(some)]
    touched, reranked = np.mean(found, axis=0) / len(index.codes)
    return {"recall": hits / max(1, true.count()), "radius": codes.radius, "retrieved": float(touched), "reranked": float(reranked)}


def nearest(table: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found for every row whose key is divisible by ``every``."""
    rows = cut(vectors.clean(table, key, vector, nonzero=True))
    codes, true = _fitted(rows, k, every)
    drop(true)
    count = rows.count()
    parts = max(1, -(-count // PART), min(2 * rows.sparkSession.sparkContext.defaultParallelism, count // 2_048))
    least = float(-(-k // parts)) if parts > 1 else float(k)  # all parts together give k
    index = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), "id", "vec", F.lit(0.0).alias("number"))
    asked = rows.where(F.col("id") % every == 0)
    queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "id", "vec", F.lit(least).alias("number"))
    return vectors.best(vectors.search(index, queries, _kernel(codes, k)), k).select("query_id", "rank", "vec_id", "score")
