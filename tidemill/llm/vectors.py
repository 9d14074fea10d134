"""What the two vector searches share: clean vectors, and a search of queries through index parts of bounded size.

Rows of one index part and the queries sent to it are sorted into one stream, the part first: a task holds one part and
takes its queries batch by batch, however many there are.  Parts give each query their best rows; a ranking over the
query's rows joins them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (ids, vectors, numbers) of a part's rows, in the order given -> a function of (ids, vectors, numbers) of queries that
#: returns rows (query, vec_id, score).
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, int, float]]]]


def clean(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", nonzero: bool = False) -> DataFrame:
    """``id`` and ``vec`` (doubles) of the rows that take part.

    Left out: null keys, vectors that are null, empty or hold null or non-finite components, with ``nonzero`` those of
    zeros alone, and vectors whose length is not the commonest one (of equally common ones the least).  Rows that repeat
    a key count once, with their least vector.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where((F.size("vec") > 0) & F.col("id").isNotNull()).where(F.forall("vec", finite))
    if nonzero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("vec") == (lengths["n"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def sample(vectors: DataFrame, most: int) -> np.ndarray:
    """``most`` vectors at most, those whose keys hash lowest."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(most).select("vec").toArrow()
    return matrix(rows.column(0).combine_chunks()) if rows.num_rows else np.empty((0, 0))


def search(index: DataFrame, queries: DataFrame, kernel: Kernel) -> DataFrame:
    """``query_id, vec_id, score`` of each query's best rows in each part that it is sent to.

    ``index``: part, id, vec, number; ``queries``: the same, once for each part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, find = None, [], None
        for batch in batches:
            parts, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[tuple[int, int, float]] = []
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                own = (piece.column(2).to_numpy(), matrix(piece.column(3)), piece.column(4).to_numpy(zero_copy_only=False))
                if parts[start] != part:
                    part, held, find = parts[start], [], None
                if kinds[start] == 0:
                    held.append(own)
                elif held:
                    find = find or kernel(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    out += find(*own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], ["query_id", "vec_id", "score"]
            )

    both = index.select("part", F.lit(0).alias("kind"), "id", "vec", "number").union(queries.select("part", F.lit(1).alias("kind"), "id", "vec", "number"))
    dealt = both.repartition("part").sortWithinPartitions("part", "kind", "number", "id")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: highest score first, ties to the smaller key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
