"""Exact top-k inner products by a pivot-distance index.

Vectors become integers, floor(scale * x).  With one more component, sqrt(M^2 - |x|^2) for rows (M: the greatest norm)
and 0 for queries, the highest inner product is the least Euclidean distance.  Each row is keyed by its nearest pivot
and its distance to it; rows sorted by that key fall into parts of bounded size, each a run of annuli around pivots.  A
query first searches the part that holds its own row.  The distance of its k-th best there bounds the rest: by the
triangle inequality, a row is no nearer than the difference of the query's and the row's distances to one pivot, so
parts, and annuli within a part, whose difference exceeds the bound are never visited.

Defined results: see ``vectors.clean`` for the rows that take part; equal scores go by key; fewer than k candidates give
all of them; an empty table gives no rows.  Scores are exact while |score| stays below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import vectors
from tidemill.llm.cut import cut

#: Pivots, rows of a part, and rows of an annulus within it, at most.
PIVOTS, PART, ANNULUS = 128, 32_768, 1_024
#: Slack for rounding of distances.
SLACK = 1e-6


def _with_pivots(rows: np.ndarray, pivots: np.ndarray, norm2: float, extra: np.ndarray) -> np.ndarray:
    """Distances of rows, with their extra component, to all pivots."""
    last = np.sqrt(np.maximum(0, norm2 - (pivots**2).sum(axis=1)))
    square = (rows**2).sum(axis=1)[:, None] + extra[:, None] ** 2 + norm2 - 2 * (rows @ pivots.T + extra[:, None] * last)
    return np.sqrt(np.maximum(0, square))


def _keyed(rows: DataFrame, pivots: np.ndarray, norm2: float) -> DataFrame:
    """Nearest pivot and distance to it, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors.matrix(batch.column(1))
            far = _with_pivots(own, pivots, norm2, np.sqrt(np.maximum(0, norm2 - (own**2).sum(axis=1)))) if len(own) else np.empty((0, 1))
            near = far.argmin(axis=1) if len(own) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far[np.arange(len(near)), near], pa.float64())], ["id", "vec", "pivot", "far"])

    return rows.mapInArrow(run, "id long, vec array<double>, pivot int, far double")


def _kernel(pivots: np.ndarray, norm2: float, k: int) -> vectors.Kernel:
    def build(ids: np.ndarray, rows: np.ndarray, _: np.ndarray):
        far = _with_pivots(rows, pivots, norm2, np.sqrt(np.maximum(0, norm2 - (rows**2).sum(axis=1))))
        pivot = far.argmin(axis=1)
        far = far[np.arange(len(rows)), pivot]
        order = np.lexsort((ids, far, pivot))
        ids, rows, pivot, far = ids[order], rows[order], pivot[order], far[order]
        edges = np.unique(np.concatenate([np.arange(0, len(ids), ANNULUS), np.flatnonzero(np.diff(pivot)) + 1, [len(ids)]]))
        annuli = list(zip(edges[:-1], edges[1:], strict=True))
        of, inner, outer = pivot[edges[:-1]], far[edges[:-1]], far[edges[1:] - 1]

        def find(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> Iterator[tuple[int, int, float]]:
            size = (queries**2).sum(axis=1) + norm2
            away = _with_pivots(queries, pivots, norm2, np.zeros(len(queries)))[:, of]
            least = np.maximum(0, np.maximum(away - outer, inner - away))
            scores, found = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
            bound = floors.copy()  # scores below this cannot be among the k best
            for a in least.sum(axis=0).argsort(kind="stable"):
                open_ = np.flatnonzero(least[:, a] <= np.sqrt(np.maximum(0, size - 2 * bound)) + SLACK)
                if not len(open_):
                    continue
                start, stop = annuli[a]
                here = np.rint(queries[open_] @ rows[start:stop].T)
                here[query_ids[open_][:, None] == ids[start:stop]] = -np.inf
                some = (here >= bound[open_][:, None]).any(axis=1) & np.isfinite(here).any(axis=1)
                open_, here = open_[some], here[some]
                if not len(open_):
                    continue
                all_scores = np.concatenate([scores[open_], here], axis=1)
                all_ids = np.concatenate([found[open_], np.broadcast_to(ids[start:stop], here.shape)], axis=1)
                top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                scores[open_], found[open_] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
                bound[open_] = np.maximum(bound[open_], scores[open_, k - 1])
            for i in range(len(queries)):
                yield from ((int(query_ids[i]), int(v), float(s)) for v, s in zip(found[i], scores[i], strict=True) if np.isfinite(s))

        return find

    return build


def _sent(queries: DataFrame, pivots: np.ndarray, norm2: float, cells: list[tuple[int, int, float, float]]) -> DataFrame:
    """Each query once for every other part that its bound cannot exclude; ``number`` is that bound."""
    part, of = (np.array([c[i] for c in cells]) for i in (0, 1))
    inner, outer = (np.array([c[i] for c in cells]) for i in (2, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, bound = vectors.matrix(batch.column(2)), batch.column(3).to_numpy()
            away = _with_pivots(own, pivots, norm2, np.zeros(len(own)))[:, of]
            reach = np.sqrt(np.maximum(0, (own**2).sum(axis=1) + norm2 - 2 * bound)) + SLACK
            at, cell = np.nonzero(np.maximum(away - outer, inner - away) <= reach[:, None])
            pairs = np.unique(np.stack([at, part[cell]]), axis=1)
            pairs = pairs[:, pairs[1] != batch.column(0).to_numpy()[pairs[0]]]
            for start in range(0, pairs.shape[1], 4096):
                at, to = pairs[:, start : start + 4096]
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *rows.columns[1:]], ["part", "id", "vec", "number"])

    return queries.select("part", "id", "vec", "number").mapInArrow(run, "part long, id long, vec array<double>, number double")


def top_k(table: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest scores of every row whose key is divisible by ``every``."""
    rows = vectors.clean(table, key, vector)
    rows = cut(rows.select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec")))
    total, norm2 = rows.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    norm2 = norm2 or 0.0
    pivots = vectors.sample(rows, max(1, min(PIVOTS, int(total**0.5))))
    if not len(pivots):
        pivots = np.zeros((1, 1))
    parts = max(1, -(-total // PART))
    keyed = _keyed(rows, pivots, norm2).repartitionByRange(parts, "pivot", "far", "id")
    index = cut(keyed.select(F.spark_partition_id().cast("long").alias("part"), "id", "vec", "pivot", "far", F.col("far").alias("number")))
    cells = [tuple(r) for r in index.groupBy("part", "pivot").agg(F.min("far"), F.max("far")).collect()]  # parts + pivots at most
    queries = index.where(F.col("id") % every == 0).select("part", "id", "vec", F.lit(float("-inf")).alias("number"))
    kernel = _kernel(pivots, norm2, k)
    home = cut(vectors.search(index, queries, kernel))
    bounds = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("number"))
    bounded = queries.drop("number").join(bounds, "id", "left").withColumn("number", F.coalesce("number", F.lit(float("-inf"))))
    found = home.union(vectors.search(index, _sent(bounded, pivots, norm2, cells), kernel)) if parts > 1 else home
    return vectors.best(found, k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
