"""Exact n-gram Jaccard join by parity sketches: links, components and link counts of documents.

A document's set is its distinct n-word shingles, each a 64-bit hash; words are maximal runs without ASCII white space,
letters A-Z in lower case.  Two documents link when ``den * intersection >= num * union``.

Sizes fall into bands.  Two linked sets differ in at most D shingles, where D follows from the largest sizes that meet
in a band; each band deals its shingles to P > D parts of a parity sketch as wide as the hashes allow: every shingle of a
part flips one bit of it, so the Hamming distance of two sketches is at most the size of their symmetric difference, and
at least P - D parts of two linked documents agree.  A part is named by the XOR of its odd bits' 64-bit names: in a part
that was only 64 bits wide, unrelated documents would agree by chance, and ever more so with more documents.  Equal parts
(band, part, word) are joined:

* a document leaves out its empty parts and its most common ones, in all less than P - D. One fixed table of counters
  gives the order for every document, so of the parts in which two linked documents agree the rarest is left out by
  neither;
* documents of one set count once; those that share a part with ``HOT`` rows at most become pairs, and pass if the Hamming distance of their whole sketches allows a link;
* those that share a part with more rows are compared by whole sketches in blocks of bounded size dealt to tasks; a block
  returns a spanning forest of the pairs that pass;
* pairs that passed form clumps (connected components). Inside a clump every pair is compared, sketches first and then
  the sets, again in blocks. No pair leaves its task: a block returns link counts and a spanning forest of its links.

Defined results: a text that is null or has no words has an empty set and links with nothing; one with fewer than n
words has its whole sequence as its only shingle; a row with a null key links with nothing, and has the component of
documents of the same set, if any, else null; repeated rows give repeated rows; other columns are not carried; a very long
text is one set in one task. Sets are told apart by 64-bit fingerprints, shingles by 64-bit hashes; two sets that share a
fingerprint stop the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.cut import cut
from tidemill.llm.graph import components

#: Words whose hashes a Python worker remembers at most; beyond, the memory starts anew.
KEPT = 60_000
#: Texts a step, so that little is held at once.
STEP = 2_000
#: Rows of a part up to which they become pairs.
HOT = 24
#: Sets of a block when sketches are compared; larger groups are compared block by block.
SKETCH_DOCS = 1_024
#: Documents and shingles of a block; clumps beyond this are compared block by block.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000
#: Counters by which parts are ordered, and those that a task reports at most; both only steer the order, never the result.
SLOTS, REPORTED = 1 << 20, 1 << 14
#: Bits of the map that spares documents without candidates a shuffle; its size is fixed, whatever the input.
MAP_BITS = 1 << 25


@dataclass(frozen=True)
class Rule:
    """Words a shingle, and the least similarity as a fraction."""

    words: int = 3
    num: int = 90
    den: int = 100

    def most_apart(self, total: int) -> int:
        """Shingles in which linked sets of these sizes together can differ at most."""
        return total * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=8)
def bands(rule: Rule) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Upper sizes of the bands, and D and P of each."""
    ratio = 1 + 2.5 * (1 - rule.num / rule.den)
    tops, top = [], 0
    while top < 1 << 40:
        top = max(top + 1, math.floor(top * ratio))
        tops.append(top)
    dealt = []
    for top in tops:
        apart = rule.most_apart(top + top * rule.den // rule.num)
        dealt.append((apart, apart + 1 + math.ceil(apart * (0.05 + 1 - rule.num / rule.den))))
    return np.array(tops), dealt


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    if len(_WORDS) > KEPT:
        _WORDS.clear()
    hashes = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(found) - size + 1 + i])
    return np.unique(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprint(hashes: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit fingerprint of a set."""
    value = xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=seed)
    return value - (1 << 64) if value >= 1 << 63 else value


def sketch(hashes: np.ndarray, rule: Rule) -> bytes:
    """Parity sketch of a whole set, eight bits or more for each shingle that a linked set of its size may differ in.

    Its width is a power of two: folding a wider sketch onto a narrower one gives the narrower one.
    """
    bits = 1 << max(6, (8 * rule.most_apart(2 * len(hashes))).bit_length())
    at = (_mixed(hashes) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches_apart(one: bytes, two: bytes) -> int:
    """Hamming distance of two sketches, the wider one folded: never more than the sets' symmetric difference."""
    a, b = int.from_bytes(one, "little"), int.from_bytes(two, "little")
    if len(one) < len(two):
        a, b, one, two = b, a, two, one
    bits = 8 * len(one)
    while bits > 8 * len(two):
        bits //= 2
        a = (a >> bits) ^ (a & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def part_keys(hashes: np.ndarray, rule: Rule, common: np.ndarray | None = None) -> list[np.ndarray]:
    """For each band that a set takes part in, the keys of its parts; given counters, without those that it may leave out."""
    size = len(hashes)
    tops, dealt = bands(rule)
    own = int(np.searchsorted(tops, size))
    out = []
    for band in (own, own - 1):
        if band < 0 or band < own and -(-size * rule.num // rule.den) > tops[band]:
            continue
        apart, parts = dealt[band]
        spread = _mixed(hashes ^ np.uint64(0x5851F42D4C957F2D))
        part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        words, filled = np.zeros(parts, np.uint64), np.zeros(parts, bool)
        np.bitwise_xor.at(words, part.astype(np.int64), _mixed(spread ^ np.uint64(0x14057B7EF767814F)))
        filled[part.astype(np.int64)] = True
        keys = _mixed(_mixed(np.arange(parts, dtype=np.uint64) + np.uint64(band << 44)) + words)
        spare = parts - apart - 1 - int(parts - filled.sum())
        if spare >= 0:  # else even some empty parts must stay
            keys = keys[filled]
            if common is not None:
                keys = keys[np.lexsort((keys, common[_slots(keys)]))[: len(keys) - spare]]
        out.append(keys)
    return out


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(SLOTS - 1)).astype(np.int64)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP))


def _base(docs: DataFrame, rule: Rule, hashed: bool = False) -> DataFrame:
    """Key, set size, two fingerprints and sketch of every document, and the third column, ``hash``, if it is ``hashed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            sets = [shingles(x, rule.words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in ([len(s) for s in sets], [fingerprint(s) for s in sets], [fingerprint(s, 1) for s in sets])), pa.array([sketch(s, rule) for s in sets], pa.binary()), *batch.columns[2:]],
                ["doc_id", "n_shingles", "f1", "f2", "sketch", *["hash"] * hashed],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, sketch binary" + ", hash long" * hashed)


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Fingerprint and set, step by step; sets that repeat in a task come once while they are remembered."""
    seen: set[int] = set()
    for batch in _steps(batches):
        seen = seen if len(seen) < KEPT else set()
        fresh = []
        for text in batch.column(0).to_pylist():
            found = shingles(text, rule.words)
            if len(found) and (f1 := fingerprint(found)) not in seen:
                seen.add(f1)
                fresh.append((f1, found))
        yield fresh


def _common(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How often parts fall to each counter, as far as tasks report it: those that stand out in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for fresh in _sets(batches, rule):
            for _, found in fresh:
                for keys in part_keys(found, rule):
                    np.add.at(counts, _slots(keys), 1)
        high = np.flatnonzero(counts >= 4 + 2 * counts.mean())
        high = high[np.argsort(-counts[high], kind="stable")[:REPORTED]]
        yield pa.RecordBatch.from_arrays([pa.array(high), pa.array(counts[high])], ["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _keys(docs: DataFrame, rule: Rule) -> DataFrame:
    """Kept part keys of every set."""
    common = _common(docs, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fresh in _sets(batches, rule):
            rows = [(f1, keys) for f1, found in fresh for keys in part_keys(found, rule, common)]
            if rows:
                owners = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate([r[1] for r in rows]))), pa.array(owners)], ["key", "f1"])

    return docs.select("text").mapInArrow(run, "key long, f1 long")


def _near(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    one, two = (classes.select(F.col("f1").alias(x), F.col("size").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch")) for x in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small, large, left, right = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            near = [
                rule.den * min(m, n) >= rule.num * max(m, n) and sketches_apart(x, y) <= rule.most_apart(m + n)
                for m, n, x, y in zip(small, large, left, right, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
    return both.mapInArrow(run, "a long, b long")


def _alike(groups: DataFrame, rule: Rule) -> DataFrame:
    """A spanning forest (a, b) of the pairs in each group whose sizes and sketches allow a link, block by block.

    ``groups`` has ``key, one, two, own, f1, size, sketch``; pairs don't leave their task.
    """

    def edges(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        rows = sorted(rows, key=lambda r: r[5])
        sizes, own, width = np.array([r[5] for r in rows]), np.array([r[3] for r in rows]), min(len(r[6]) for r in rows)
        words = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[6], np.uint64).reshape(-1, width // 8), axis=0) for r in rows])
        near = []
        for i in range(len(rows) - 1):
            end = np.searchsorted(sizes, sizes[i] * rule.den // rule.num, side="right")
            apart = np.bitwise_count(words[i + 1 : end] ^ words[i]).sum(axis=1, dtype=np.int64)
            fits = apart <= (sizes[i + 1 : end] + sizes[i]) * (rule.den - rule.num) // (rule.den + rule.num)
            if rows[0][1] != rows[0][2]:
                fits &= own[i + 1 : end] != own[i]
            near.append((i, np.flatnonzero(fits) + i + 1))
        return [(rows[i][4], rows[j][4]) for i, j in forest((i, int(j)) for i, js in near for j in js)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    found += edges(group)
                    group = []
                group.append(row)
            yield _pairs(found)
        yield _pairs(edges(group))

    by = ["key", "one", "two"]
    return groups.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _paired_blocks(rows: DataFrame) -> DataFrame:
    """The rows with ``one, two, own``, once for each pair of blocks that holds the row's own block."""
    own = F.pmod(F.xxhash64("f1"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return rows.select("*", own.alias("own"), other).withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("other", "blocks")


def _clumps(keys: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Set fingerprint and clump of every set that may link with another one."""
    of_key = Window.partitionBy("key")
    after = F.collect_list("f1").over(of_key.orderBy("f1").rowsBetween(1, HOT))
    shared = keys.select("*", F.min("f1").over(of_key).alias("lo"), F.max("f1").over(of_key).alias("hi"), (F.count("*").over(of_key) > HOT).alias("hot"), after.alias("after")).where("lo != hi")
    shared = cut(shared.select("f1", F.when(F.col("hot"), F.col("key")).alias("key"), F.when(~F.col("hot"), F.array_distinct("after")).alias("after")))
    pairs = shared.select(F.col("f1").alias("a"), F.explode("after").alias("b")).where("a < b").distinct()
    kept = shared.where(F.col("key").isNotNull()).select("key", "f1").distinct()
    blocks = kept.groupBy("key").agg(F.ceil(F.count("*") / SKETCH_DOCS).cast("long").alias("blocks"))
    groups = _paired_blocks(kept.join(blocks, "key").join(classes.select("f1", "size", "sketch"), "f1"))
    alike = _alike(groups.select("key", "one", "two", "own", "f1", "size", "sketch"), rule)
    found = components(_near(pairs, classes, rule).union(alike))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())


def _likely(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose key may be among the chosen ones: all of those, and as few others as the fixed map allows."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))
    words = chosen.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.uint64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy().astype(np.uint64)
            set_ = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(set_ == 1))

    return rows.select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id long, text string")


def _blocks(members: DataFrame, rule: Rule) -> DataFrame:
    """Clump, block pair, own block, fingerprint, copies and set, once for each block pair that compares the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, rule.words) for x in batch.column(4).to_pylist()]
            own = [fingerprint(s) == f1 for s, f1 in zip(sets, batch.column(1).to_pylist(), strict=True)]  # a key may repeat with another text
            hashes = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], hashes], ["clump", "f1", "copies", "blocks", "hashes"]).filter(pa.array(own, pa.bool_()))

    dealt = members.select("clump", "f1", "copies", "blocks", "text").mapInArrow(run, "clump long, f1 long, copies long, blocks long, hashes binary")
    return _paired_blocks(dealt).select("clump", "one", "two", "own", "f1", "copies", "hashes")


def compare(sets: list[np.ndarray], block: np.ndarray, cross: bool, rule: Rule) -> list[tuple[int, int]]:
    """Linked pairs among sets, those of different blocks only if ``cross``: by sketches, then exactly."""
    sizes = np.array([len(s) for s in sets])
    width = max(1, min(256, int(sizes.max()) // 12))
    sketches = np.zeros((len(sets), width), np.uint64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    spread = _mixed(flat)
    np.bitwise_xor.at(sketches, (owner, ((spread >> np.uint64(40)) % np.uint64(width)).astype(np.int64)), np.left_shift(np.uint64(1), spread & np.uint64(63)))
    codes = np.unique(flat, return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(codes.max() + 1, bool)
    links = []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        if cross:
            rest = rest[block[rest] != block[i]]
        low, high = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[rule.den * low >= rule.num * high]
        apart = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        rest = rest[apart <= (sizes[rest] + sizes[i]) * (rule.den - rule.num) // (rule.den + rule.num)]
        if not len(rest):
            continue
        mark[codes[starts[i] : starts[i + 1]]] = True
        for j in rest:
            both = int(np.count_nonzero(mark[codes[starts[j] : starts[j + 1]]]))
            if rule.den * both >= rule.num * (int(sizes[i]) + int(sizes[j]) - both):
                links.append((i, int(j)))
        mark[codes[starts[i] : starts[i + 1]]] = False
    return links


def forest(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of these links."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    kept = []
    for i, j in links:
        a, b = root(i), root(j)
        if a != b:
            above[max(a, b)] = min(a, b)
            kept.append((i, j))
    return kept


def _links(blocks: DataFrame, rule: Rule) -> DataFrame:
    """``a, b`` of a forest of links where ``n`` is null, and link counts ``n`` of ``a`` where b is null."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def pairs(rows: list[tuple]) -> Iterator[tuple[int, int | None, int | None]]:
        if len(rows) < 2:
            return
        _, one, two, _, _, _, _ = rows[0]
        rows = sorted({r[4]: r for r in rows}.values(), key=lambda r: len(r[6]))
        links = compare([np.frombuffer(r[6], np.uint64) for r in rows], np.array([r[3] for r in rows]), one != two, rule)
        counts: dict[int, int] = {}
        for i, j in links:
            counts[i] = counts.get(i, 0) + rows[j][5]
            counts[j] = counts.get(j, 0) + rows[i][5]
        yield from ((rows[i][4], rows[j][4], None) for i, j in forest(links))
        yield from ((rows[i][4], None, n) for i, n in counts.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    out += pairs(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip("abn", r, strict=True)) for r in out], schema)
        if out := list(pairs(group)):
            yield pa.RecordBatch.from_pylist([dict(zip("abn", r, strict=True)) for r in out], schema)

    by = ["clump", "one", "two"]
    return blocks.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long, n long")


def _placed(rows: DataFrame, base: DataFrame, rule: Rule) -> DataFrame:
    """``base`` with the ``root`` of each set, and the component and links of its documents; no set, no root.

    Rows of ``base`` without a key have what documents of the same set have, and change nothing.
    """
    clash = F.when(F.min("f2") != F.max("f2"), F.raise_error(F.lit("two sets share a fingerprint"))).otherwise(F.count("*"))
    classes = cut(base.where("n_shingles > 0 and doc_id is not null").groupBy("f1").agg(F.min("doc_id").alias("rep"), clash.cast("long").alias("copies"), F.max("n_shingles").alias("size"), F.min("sketch").alias("sketch")))
    clumps = cut(_clumps(_keys(rows, rule), classes, rule).toDF("f1", "clump").join(classes.drop("sketch"), "f1"))
    sizes = clumps.groupBy("clump").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
    chosen = cut(clumps.join(sizes, "clump").select(F.col("rep").alias("doc_id"), "clump", "f1", "copies", "blocks"))
    links = cut(_links(_blocks(_likely(rows, chosen).join(chosen, "doc_id"), rule), rule))
    roots = components(links.where("n is null"))
    counts = links.where("n is not null").groupBy(F.col("a").alias("f1")).agg(F.sum("n").alias("n"))
    placed = classes.join(roots.withColumnRenamed("node", "f1"), "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = placed.join(least, "root").join(counts, "f1", "left").select("f1", "root", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return base.join(of_class, "f1", "left")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def join(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (least document that it reaches) and ``n_links`` (documents linked with it)."""
    rows = _rows(docs, key, text)
    links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return _placed(rows.where("doc_id is not null"), cut(_base(rows, rule)), rule).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), links.alias("n_links"))


def keep_first(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without those whose own text is linked, straight or through others, to a row before it by (key, hash of the text).

    A key that repeats with other texts counts as other documents. Of rows equal in key and text the least by all columns stays;
    rows without words or key stay.
    """
    rows, own = _rows(docs, key, text).where("doc_id is not null"), ["_" * max(map(len, docs.columns)) + name for name in ("key", "hash")]
    base = cut(_base(rows.withColumn("hash", F.xxhash64("text")), rule, hashed=True))
    placed = cut(_placed(rows, base, rule).where("root is not null").groupBy("root", "doc_id", "hash").agg(F.count("*").alias("copies")))
    first = placed.groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    placed = cut(placed.join(first, "root").select(F.col("doc_id").alias(own[0]), F.col("hash").alias(own[1]), "copies", (F.struct("doc_id", "hash") == F.col("first")).alias("first")))
    marked = docs.withColumn(own[0], F.col(key).cast("long")).withColumn(own[1], F.xxhash64(text))
    kept = marked.join(placed.where("not first").select(*own), own, "left_anti")
    repeated = placed.where("first and copies > 1").select(*own)
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    ordered = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]  # maps have no order
    once = kept.join(repeated, own, "left_semi").groupBy(*own).agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias(own[0] + "_")).select(f"{own[0]}_.*")
    return kept.join(repeated, own, "left_anti").select(*docs.columns).unionByName(once)
