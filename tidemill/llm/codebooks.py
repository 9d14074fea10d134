"""Compression of vectors to short codes: one codebook a part of the vector, learned in rounds over all rows.

Each round puts a kd-tree of every codebook into a broadcast (256 entries a part, whatever the table).  The search goes
down to the nearer child first and leaves out a node only where the distance to its box is *above* the best so far: nodes at
an equal bound are visited, so that of equally near entries the lowest index is found.  It runs over many vectors at once,
which part at each node into those nearer to one child and those nearer to the other.  Tasks add up the integer parts that
each entry got, Spark adds up the tasks' sums, and the driver receives one row an entry.  All arithmetic is in integers.

Defined results.  Rows whose vector is null or holds null or non-finite components take no part; all others do, repeated
rows and null keys too (null keys come last, equal keys by vector, when the first entries are chosen).  Shorter vectors
count as if zeros followed, up to the longest length, rounded up to a multiple of the parts.  Components are held to
``bound(width)`` in size, below which no distance leaves 64 bits.  With fewer rows than entries, codebooks are shorter; an
empty table gives an empty frame.  Columns other than key, vector and label are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.cut import cut, drop
from tidemill.llm.vectors import matrix

#: Entries of a leaf at most.
LEAF = 8
#: Vectors a step.
STEP = 4_096
#: A label with more rows than this is joined by broadcast; there are at most rows / HOT of them.
HOT = 1_000_000


def bound(width: int) -> int:
    """The largest size of a scaled component: squared distances over ``width`` of them stay below 2^62."""
    return math.isqrt(2**62 // max(width, 1)) // 2


@dataclass
class Node:
    """A box around entries: a leaf with their indexes in ascending order, or two children split at a value of one position."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    at: int = -1
    middle: int = 0
    children: tuple[Node, Node] | None = None


def tree(book: np.ndarray, entries: np.ndarray | None = None) -> Node:
    """The kd-tree of a codebook: the widest position is split at the middle entry."""
    entries = np.arange(len(book)) if entries is None else entries
    own = book[entries]
    node = Node(own.min(axis=0), own.max(axis=0), entries)
    spread = node.high - node.low
    if len(entries) > LEAF and spread.max(initial=0) > 0:
        node.at = int(spread.argmax())
        values = np.sort(own[:, node.at])
        node.middle = int(values[len(values) // 2])
        if node.middle == values[0]:
            node.middle = int(values[np.searchsorted(values, values[0], "right")])
        left = own[:, node.at] < node.middle
        node.children = (tree(book, entries[left]), tree(book, entries[~left]))
    return node


def nearest(book: np.ndarray, root: Node, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest entry, ties to the lower index."""
    best = np.full(len(rows), np.iinfo(np.int64).max)
    which = np.full(len(rows), len(book))

    def visit(node: Node, active: np.ndarray) -> None:
        away = np.maximum(node.low - rows[active], rows[active] - node.high)
        np.maximum(away, 0, out=away)
        active = active[np.einsum("ij,ij->i", away, away) <= best[active]]
        if not len(active):
            return
        if node.children:
            left = rows[active, node.at] < node.middle
            for near, own in ((0, active[left]), (1, active[~left])):
                visit(node.children[near], own)
                visit(node.children[1 - near], own)
            return
        for entry in node.entries:
            away = rows[active] - book[entry]
            distance = np.einsum("ij,ij->i", away, away)
            better = (distance < best[active]) | (distance == best[active]) & (entry < which[active])
            best[active[better]], which[active[better]] = distance[better], entry

    visit(root, np.arange(len(rows)))
    return which, best


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part (parts x entries x width of a part), and the scale of components."""

    entries: np.ndarray
    scale: int

    @property
    def width(self) -> int:
        """Components of a vector."""
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The scaled vectors that rows of entry indexes (rows x parts) stand for."""
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.entries)], axis=1)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def scaled(vectors: DataFrame, parts: int, scale: int, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> tuple[DataFrame, int]:
    """``vec_id, label, vec`` of the rows that take part, components as integers of one width, and that width."""
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    own = own.where(_finite(F.col("vec")))
    longest = own.agg(F.max(F.size("vec"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    most = bound(width)
    whole = F.transform("vec", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(most))), F.lit(-float(most)))).cast("long"))
    return own.withColumn("vec", F.concat(whole, F.array_repeat(F.lit(0).cast("long"), width - F.size("vec")))), width


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP))


def _summed(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round."""
    parts, size, width = books.shape
    shared = rows.sparkSession.sparkContext.broadcast([(book, tree(book)) for book in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in _steps(batches):
            whole = matrix(batch.column(0))
            for i, (book, root) in enumerate(shared.value):
                own = whole[:, i * width : (i + 1) * width]
                which, _ = nearest(book, root, own)
                order = np.argsort(which, kind="stable")
                used, starts = np.unique(which[order], return_index=True)
                sums[i, used] += np.add.reduceat(own[order], starts, axis=0)
                counts[i, used] += np.diff([*starts, len(order)])
        part, entry = counts.nonzero()
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    tasks = rows.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    added = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
    books = books.copy()
    for r in added.collect():
        books[r["part"], r["entry"]] = np.array(r["sums"]) // r["n"]
    shared.destroy()
    return books


def fit(rows: DataFrame, width: int, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024) -> Codebooks:
    """Codebooks of rows that ``scaled`` gave: ``size`` entries each, from the rows of the least keys, moved in each round to the mean of their parts."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(size).select("vec").collect()
    start = np.array([r["vec"] for r in first], np.int64).reshape(len(first), parts, width // parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        books = _summed(rows, books)
    return Codebooks(books, scale)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code`` (two hex digits, or as many as the largest index needs, a part) ``, error`` of rows that ``scaled`` gave."""
    parts, size, width = books.entries.shape
    digits = max(2, len(f"{max(size - 1, 0):x}"))
    schema = T.StructType([*(rows.schema[c] for c in ("vec_id", "label")), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    shared = rows.sparkSession.sparkContext.broadcast([(book, tree(book)) for book in books.entries] if size else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            whole = matrix(batch.column(2))
            error, code = np.zeros(len(whole), np.int64), np.full(len(whole), "", object)
            for i, (book, root) in enumerate(shared.value):
                which, distance = nearest(book, root, whole[:, i * width : (i + 1) * width])
                error += distance
                code += np.array([f"{x:0{digits}x}" for x in range(size)], object)[which]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "vec").mapInArrow(run, schema)


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows of ``encode`` with ``label_error``, the errors of equal labels (nulls together) added up."""
    coded = cut(coded)
    total = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))

    def joined(rows: DataFrame, sums: DataFrame, how: str) -> DataFrame:
        a, b = rows.alias("a"), sums.alias("b")
        return a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")), how).select("a.*", *(["b.label_error"] if how == "inner" else []))

    hot = F.broadcast(total.where(F.col("n") > HOT))
    return joined(coded, hot, "inner").union(joined(joined(coded, hot, "left_anti"), total, "inner"))


__all__ = ["Codebooks", "bound", "drop", "encode", "fit", "nearest", "scaled", "tree", "with_label_error"]
