"""Language-model scores of whole texts by logistic context mixing over bits.

A text counts as its tokens: words (runs without ASCII white space, A-Z in lower case), each with a space after it, and
one end.  It is told in bits, and every bit is predicted by several contexts whose stretched probabilities are combined
by weights that a gate selects; an adaptive map then refines the result.  There are three kinds of bits:

* *repeats*: the words of a text form passages, cut behind words chosen by their hash (one in ``CUTS``).  Where the passage
  before has been followed by others in training, a bit tells whether one of those follows, and if so, its share of them
  tells which.  Contexts: how often the passage before was seen, and how the last repeat bits came out;
* *shapes*: a word that is not part of a repeated passage first tells its shape (ending, length, letters beyond ASCII; the
  end is a shape of its own) in six bits.  Contexts: shapes of the one or two words before, and how many of the last
  eight words hold such letters;
* *bytes*: then its bytes, bit by bit.  Contexts: shape and last byte, the last two and three bytes, hashed into tables,
  and the shape with the whole word so far, counted exactly.

What is gathered grows with the corpus: counts of passages, and of all beginnings of all distinct words, stay in tables
that are dealt to tasks; only contexts of bounded alphabets (shapes, up to three bytes) have tables of fixed size.  All
training tokens move the counts, the weights and the maps: repeats and shapes through their exact counts, bytes in an
online pass over all words in tasks, whose results are averaged by the tokens that they saw.

A training document is scored as if new: each token's own occurrence is taken out of the counts of passages, beginnings
and bytes.  So a text that stands twice in the training data, or once there and once beside it, is told by its repeats.

Documents form blocks (one row each) with a dictionary.  Dictionaries are dealt by order of the words to ranges of bounded
size, passages by hash; both answer each block in a row of their own, so no word or passage is a hot key: a block asks
once for it.  Beginnings that cross the border of a range are added up through its first and last word.

Defined results: a null text counts as empty (its end alone); a null key is given as null, not held out; repeated rows
count and score each; without training documents all counts are 0; a very long text is a block of its own; other columns
are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import random
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cut import cut, drop

#: Bytes of a block's texts, words of a range, passage keys of a range, and the share of words that end a passage.
BLOCK, RANGE, KEYS, CUTS = 3_000_000, 250_000, 500_000, 8
#: Learned numbers are averaged as integers of this many parts of one.
PARTS_OF_ONE = 1 << 24
#: Words of a unit of learning, and words whose quantiles are the units' borders.
UNIT, KEPT = 250_000, 16_384
#: Hashed orders and the bits of their slots; bytes of words that are handled together.
ORDERS, SLOTS, TOGETHER = 3, 20, 40_000
#: Blocks whose dictionaries place the borders of ranges, and words that each gives, at most.
PLACED, GIVEN = 256, 512
SPACE, END, SHAPES, STATES = 32, 7, 64, 4
REPEATS = 30
_A = 0x9E3779B97F4A7C15 | 1
_CODEC = pa.Codec("zstd", 1)
#: First bytes of tokens, by shape.
LEADS = [bytes([64 + k]) for k in range(SHAPES)]


# ---- small helpers ---------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def unpacked(data: bytes, kind: type) -> np.ndarray:
    """The array of ``packed``."""
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.empty(0, kind)
    planes = np.frombuffer(_CODEC.decompress(data[8:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _packed_text(items: list[bytes]) -> bytes:
    joined = b"\n".join(items)
    return len(joined).to_bytes(8, "little") + (_CODEC.compress(joined, asbytes=True) if joined else b"")


def _unpacked_text(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], size, asbytes=True).split(b"\n") if size else []


def _in_order(tokens: list[bytes]) -> list[int]:
    """Places of tokens in the order of their bytes, each with its space; text of one byte a letter is compared faster than bytes."""
    keys = [(t + b" ").decode("latin-1") for t in tokens]
    return sorted(range(len(tokens)), key=keys.__getitem__)


def _ascending(values: np.ndarray) -> bytes:
    """An ascending array by its steps."""
    return packed(np.diff(values, prepend=values.dtype.type(0)))


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -12, 12)))


def odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched probability of a one, from counts of zeros and ones."""
    return np.log((ones + np.float32(0.02)) / (zeros + np.float32(0.02)))


def level(total: np.ndarray) -> np.ndarray:
    """How well a context is known, from 0 to 3."""
    return ((total > 0.5).view(np.int8) + (total > 3.5).view(np.int8) + (total > 30.5).view(np.int8)).astype(np.int64)


def without_own(zeros: np.ndarray, ones: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (orders x rows) without one occurrence of each row's own bit."""
    one = value.astype(np.float32)
    return np.maximum(zeros - (1 - one), 0), np.maximum(ones - one, 0)


@dataclass
class Mixer:
    """Gated weights (inputs x gates, the last a bias) and the adaptive map (contexts x steps of the stretched mix)."""

    weights: np.ndarray
    refined: np.ndarray

    @staticmethod
    def new(inputs: int, gates: int, contexts: int) -> Mixer:
        """A mixer that has learned nothing."""
        weights = np.full((inputs + 1, gates), 1.2 / inputs, np.float32)
        weights[-1] = 0
        return Mixer(weights, np.tile(_squash(np.linspace(-8, 8, 33)), (contexts, 1)).astype(np.float32))

    def mixed(self, x: np.ndarray, gate: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mixed probability of inputs x (inputs x rows), and the map's lower step (flat) with the share of the next."""
        stretched = self.weights[-1].take(gate, mode="clip")  # places are always valid; so none is checked
        for own, row in zip(self.weights[:-1], x, strict=True):
            stretched = stretched + own.take(gate, mode="clip") * row
        stretched = np.minimum(np.maximum(stretched, np.float32(-7.99)), np.float32(7.99))
        step = (stretched + np.float32(8)) * np.float32(2)
        low = step.astype(np.int64)
        share = step - low.astype(np.float32)
        low += context * 33
        return 1 / (1 + np.exp(-stretched)), low, share

    def final(self, x: np.ndarray, gate: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Final probability: the mix and what the map makes of it."""
        mixed, low, share = self.mixed(x, gate, context)
        flat = self.refined.ravel()
        before = flat.take(low, mode="clip")
        refined = before + (flat.take(low + 1, mode="clip") - before) * share
        return np.minimum(np.maximum((mixed + refined) / 2, np.float32(1e-5)), np.float32(1 - 1e-5))

    def learn(self, x: np.ndarray, gate: np.ndarray, context: np.ndarray, value: np.ndarray, times: np.ndarray, rate: float = 0.02) -> None:
        """One step over bits that occur ``times`` each: weights by the mean slope of each gate, the map by its errors."""
        mixed, low, share = self.mixed(x, gate, context)
        error = (value - mixed) * times
        gates = self.weights.shape[1]
        total = np.bincount(gate, times, gates)
        slope = np.stack([np.bincount(gate, error * row, gates) for row in x] + [np.bincount(gate, error, gates)]) / np.maximum(total, 1e-9)
        self.weights += (rate * slope * np.minimum(1, total / 50)).astype(np.float32)
        flat = self.refined.ravel()
        for at, part in ((low, (1 - share) * times), (low + 1, share * times)):
            moved = np.bincount(at, part * (value - flat[at]), len(flat))
            flat += (moved / (np.bincount(at, part, len(flat)) + 30)).astype(np.float32)


# ---- shapes and passages of a block ----------------------------------------------------------------------------------


def shapes(words: list[bytes]) -> np.ndarray:
    """Shape of each word: letters beyond ASCII (1 bit), ending (2 bits), length (3 bits)."""
    if not words:
        return np.empty(0, np.uint8)
    flat, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    last = flat[ends - 1]
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
    ending = np.select([letter, last == 44, np.isin(last, (33, 46, 63))], [0, 1, 2], 3)
    beyond = np.maximum.reduceat(flat, ends - sizes) >= 128
    return (beyond * 32 + ending * 8 + np.digitize(sizes, (2, 3, 4, 6, 8, 11))).astype(np.uint8)


def sequence(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of documents one after the other, each with its end; the document of each token, and where each starts."""
    documents = np.arange(len(sizes), dtype=np.int32)
    owner = np.repeat(documents, sizes + 1)
    starts = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int32)
    out = np.full(len(owner), end, np.int32)
    out[np.arange(len(codes), dtype=np.int32) + np.repeat(documents, sizes)] = codes
    return out, owner, starts


def shape_keys(own: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token the state, the shapes of the two tokens before, and its own shape, as one number."""
    at = np.arange(len(own), dtype=np.int32)
    place = at - starts[owner]
    one, two = np.full(len(own), END, np.int32), np.full(len(own), END, np.int32)
    one[1:], two[2:] = own[:-1], own[:-2]
    one[place < 1] = END
    two[place < 2] = END
    beyond = np.concatenate([np.zeros(1, np.int32), np.cumsum(own >= 32, dtype=np.int32)])
    recent = beyond[:-1] - beyond[at - np.minimum(place, 8)]
    state = (recent >= 1).astype(np.int32) + (recent >= 2) + (recent >= 4)
    return ((state * SHAPES + two) * SHAPES + one) * SHAPES + own


@dataclass
class Passages:
    """Where passages start, and their keys: of the passage before, and of it with the passage."""

    starts: np.ndarray
    owner: np.ndarray
    keys: np.ndarray  # distinct, ascending, 56 bits
    before: np.ndarray  # places in ``keys``
    both: np.ndarray


def passages(seq: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> Passages:
    """Passages of a sequence of tokens; ``hashes`` has one for each code, the end's last."""
    of = hashes[seq]
    ends = ((of >> np.uint64(7)) % np.uint64(CUTS) == 0) | (seq == len(hashes) - 1)
    starts = np.flatnonzero(np.concatenate([[True], ends[:-1]])) if len(seq) else np.empty(0, np.int64)
    if not len(starts):
        return Passages(starts, starts, np.empty(0, np.uint64), starts, starts)
    sizes = np.diff(np.append(starts, len(seq)))
    place = np.arange(len(seq), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(sizes.max()), _A, np.uint64))])
    of *= powers[place]
    own = _mixed(np.add.reduceat(of, starts))
    before = np.concatenate([np.zeros(1, np.uint64), own[:-1]])
    before[np.concatenate([[True], np.diff(owner[starts]) != 0])] = 1  # nothing before
    keys = np.concatenate([_mixed(before * np.uint64(_A) + np.uint64(5)), _mixed(_mixed(before * np.uint64(_A) + np.uint64(11)) + own)]) >> np.uint64(8)
    distinct, at = np.unique(keys, return_inverse=True)
    return Passages(starts, owner[starts], distinct, at[: len(own)], at[len(own) :])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, and at last that of the end."""
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.append(out, np.uint64(0x7F4A7C15D6E8FEB8))


_BLOCK = {
    "block": pa.int64(), "words": pa.binary(), "counts": pa.binary(), "entries": pa.int64(), "keys": pa.binary(), "seen": pa.binary(), "asked": pa.int64(),
    "shape": pa.binary(), "shapes": pa.binary(), "doc_id": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "sizes": pa.binary(), "codes": pa.binary(), "ends": pa.int64(),
}
_BLOCK_SQL = "block long, words binary, counts binary, entries long, keys binary, seen binary, asked long, shape binary, shapes binary, doc_id array<long>, held_out array<boolean>, sizes binary, codes binary, ends long"


def _block(keys: list, texts: list, held: list) -> pa.RecordBatch:
    """One row for these documents: dictionary, passage keys and shapes with their training counts, and the texts as codes."""
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    codes, sizes = [], []
    for text in texts:
        words = text.encode().lower().split() if text else []
        codes.append(np.fromiter(map(place.__getitem__, words), np.uint32, len(words)))
        sizes.append(len(words))
    place.default_factory = None  # else it and the dictionary would hold each other
    found = list(place)
    kinds = shapes(found)
    tokens = [LEADS[k] + w for k, w in zip(kinds.tolist(), found, strict=True)]
    order = _in_order(tokens)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    sizes_, train = np.array(sizes, np.int32), ~np.array(held, bool)
    flat = rank[np.concatenate(codes)] if len(found) else np.empty(0, np.int64)
    seq, owner, starts = sequence(flat, sizes_, len(found))
    learned = train[owner]
    counts = np.bincount(seq[learned], minlength=len(found) + 1)
    own = np.append(kinds[order], END).astype(np.int32)[seq]
    shape, shape_times = np.unique(shape_keys(own, owner, starts)[learned], return_counts=True)
    cut_ = passages(seq, owner, word_hashes([found[i] for i in order]))
    seen = np.zeros(len(cut_.keys), np.int64)
    for at in (cut_.before, cut_.both):
        seen += np.bincount(at[train[cut_.owner]], minlength=len(seen))
    row = {
        "block": random.SystemRandom().getrandbits(62),  # written once, so a random name is as good as any
        "words": _packed_text([tokens[i] for i in order]), "counts": packed(counts[:-1].astype(np.uint32)), "entries": len(found),
        "keys": _ascending(cut_.keys), "seen": packed(seen.astype(np.uint32)), "asked": len(cut_.keys),
        "shape": _ascending(shape.astype(np.uint32)), "shapes": packed(shape_times.astype(np.uint32)),
        "doc_id": keys, "held_out": held, "sizes": packed(sizes_.astype(np.uint32)), "codes": packed(flat.astype(np.uint32)), "ends": int(train.sum()),
    }
    return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in _BLOCK.items()], list(_BLOCK))


def _blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of documents; see ``_block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held, size = [], [], [], 0
        for batch in batches:
            for row in _rows(batch):
                keys.append(row["doc_id"])
                texts.append(row["text"])
                held.append(row["held_out"])
                size += len(row["text"] or "") + 20
                if size >= BLOCK:
                    yield _block(keys, texts, held)
                    keys, texts, held, size = [], [], [], 0
        if keys:
            yield _block(keys, texts, held)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, _BLOCK_SQL)


def _added(total: np.ndarray, at: np.ndarray, times: np.ndarray) -> None:
    """Add numbers at places that may repeat; they are made of the total's kind, or else numpy takes several times as long."""
    np.add.at(total, at, times.astype(total.dtype, copy=False))


def _summed(df: DataFrame, size: int, each: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> np.ndarray:
    """The sum of sparse vectors of a fixed size: tasks add what ``each`` finds in a batch, then parts are added."""
    width = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at, times in each(batch):
                _added(total, at, times)
        for start in range(0, size, width):
            at = np.flatnonzero(total[start : start + width])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([start // width], pa.int32()), pa.array([_ascending(at.astype(np.uint32))]), pa.array([packed(total[start + at])])], ["part", "at", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for at, times in zip(group.column("at"), group.column("n"), strict=True):
            total[np.cumsum(unpacked(at.as_py(), np.uint32))] += unpacked(times.as_py(), np.float64)
        return pa.table([group.column("part").slice(0, 1), pa.array([packed(total.astype(np.float32))])], ["part", "n"])

    out = np.zeros(-(-size // width) * width, np.float32)
    for part, times in df.mapInArrow(run, "part int, at binary, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[part * width : (part + 1) * width] = unpacked(times, np.float32)
    return out[:size]


# ---- words in order: beginnings --------------------------------------------------------------------------------------


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one: blobs are large, so no more than one row is taken out of it at a time."""
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each value of the first column, by which they are sorted."""
    value, rows = None, []
    for batch in batches:
        for row in _rows(batch):
            own = row[batch.schema.names[0]]
            if rows and own != value:
                yield value, rows
                rows = []
            value = own
            rows.append(row)
    if rows:
        yield value, rows


def _borders(table: DataFrame, entries: int, blocks: int) -> list[bytes]:
    """Words that part the ranges, by a sample of the blocks' dictionaries."""
    parts = -(-entries // RANGE)
    if parts < 2:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for row in _rows(batch) for own in [_unpacked_text(row["words"])] for w in own[:: max(1, len(own) // GIVEN)]]
            yield pa.RecordBatch.from_arrays([pa.array([w[:64] + b" " for w in words], pa.binary())], ["word"])

    some = F.pmod(F.xxhash64("block"), F.lit(max(1, blocks // PLACED))) == 0
    found = sorted(r.word for r in table.where(some).select("words").mapInArrow(run, "word binary").collect())
    return sorted({bytes(found[i * len(found) // parts]) for i in range(1, parts)}) if found else []


def _merged(table: DataFrame, borders: list[bytes]) -> DataFrame:
    """For each range a row with its distinct words in order and their counts, and a row for each block with the places of its words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block, own, times = row["block"], _unpacked_text(row["words"]), unpacked(row["counts"], np.uint32)
                cuts = [0, *(bisect.bisect_left(own, b, key=lambda w: w + b" ") for b in borders), len(own)]
                some = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
                columns = [some, [block] * len(some), [_packed_text(own[cuts[i] : cuts[i + 1]]) for i in some], [packed(times[cuts[i] : cuts[i + 1]]) for i in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "words", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in _grouped(batches):
            slices = [_unpacked_text(r["words"]) for r in rows]
            distinct = list(dict.fromkeys(itertools.chain.from_iterable(slices)))
            distinct = [distinct[i] for i in _in_order(distinct)]
            place = {w: i for i, w in enumerate(distinct)}
            times = np.zeros(len(distinct), np.int64)
            at = []
            for row, own in zip(rows, slices, strict=True):
                at.append(np.fromiter(map(place.__getitem__, own), np.uint32, len(own)))
                times[at[-1]] += unpacked(row["counts"], np.uint32)
            columns = {
                "range": [value] * (len(rows) + 1), "block": [None, *(r["block"] for r in rows)], "words": [_packed_text(distinct), *[None] * len(rows)],
                "n": [packed(times), *[None] * len(rows)], "at": [None, *map(_ascending, at)], "total": [int(times.sum()), *[None] * len(rows)], "kinds": [int((times > 0).sum()), *[None] * len(rows)],
            }
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds, strict=True)], list(columns))

    slices = table.select("block", "words", "counts").mapInArrow(split, "range long, block long, words binary, counts binary")
    dealt = slices.repartition(len(borders) + 1, "range").sortWithinPartitions("range", "block")
    return dealt.mapInArrow(merge, "range long, block long, words binary, n binary, at binary, total long, kinds long")


def _beginnings(token: bytes) -> np.ndarray:
    """Hashes of the beginnings of a token, by length from 1 to the whole."""
    flat = np.frombuffer(token, np.uint8).astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(len(flat), _A, np.uint64))
    return _mixed(np.cumsum(flat * powers, dtype=np.uint64) + np.arange(1, len(flat) + 1, dtype=np.uint64)).view(np.int64)


def _run_of(tokens: list[bytes], length: int, first: bool) -> tuple[int, int]:
    """Which tokens begin like the first (or the last) one."""
    start = tokens[0 if first else -1][:length]
    if first:
        return 0, bisect.bisect_right(tokens, start, key=lambda t: t[:length])
    return bisect.bisect_left(tokens, start, key=lambda t: t[:length]), len(tokens)


def border_counts(tokens: list[bytes], n: np.ndarray) -> dict[int, dict[int, float]]:
    """For each beginning of the first and of the last token: how often each byte follows it here."""
    out: dict[int, dict[int, float]] = {}
    for first in (True, False):
        token = tokens[0 if first else -1]
        names = _beginnings(token).tolist()
        alone = False
        for length in range(1, len(token)):
            if names[length - 1] in out:
                continue
            start, stop = (0, 1) if alone and first else (len(tokens) - 1, len(tokens)) if alone else _run_of(tokens, length, first)
            alone = stop - start == 1
            if alone:
                out[names[length - 1]] = {tokens[start][length]: float(n[start])}
            else:
                follows = np.bincount(np.fromiter((t[length] for t in tokens[start:stop]), np.int64, stop - start), n[start:stop])
                out[names[length - 1]] = {int(b): float(follows[b]) for b in np.flatnonzero(follows)}
    return out


def counted_beginnings(tokens: list[bytes], n: np.ndarray, wide: dict[int, dict[int, float]] | None = None) -> np.ndarray:
    """How often zero and one follow what is before (bits x 2 x bytes), for each byte behind the shape of sorted tokens.

    ``wide`` has the counts, over all ranges, of the beginnings of the first and the last token.
    """
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1
    flat = np.frombuffer(b"".join(t[1:] for t in tokens), np.uint8)
    lead = np.fromiter((t[0] for t in tokens), np.uint8, len(tokens))
    starts = np.cumsum(sizes) - sizes
    weight = n.astype(np.float64)
    each = np.repeat(weight, sizes).astype(np.float32)
    seen = np.zeros((8, 2, len(flat)), np.float32)
    for bit in range(8):
        one = (flat >> np.uint8(7 - bit)) & np.uint8(1)
        seen[bit, 1] = each * one
        seen[bit, 0] = each - seen[bit, 1]
    alive = np.arange(len(tokens))
    same = np.concatenate([[False], lead[1:] == lead[:-1]])
    depth = 0
    while True:
        joined = same | np.append(same[1:], False)  # shares its beginning with a neighbour
        alive, same = alive[joined], same[joined]
        if not len(alive):
            break
        at = starts[alive] + depth
        byte, times = flat[at], weight[alive]
        head = ~same
        head[0] = True
        for bit in range(8):
            begin = np.flatnonzero(head)
            run = np.cumsum(head) - 1
            value = (byte >> np.uint8(7 - bit)) & np.uint8(1)
            ones = np.add.reduceat(times * value, begin)
            all_ = np.add.reduceat(times, begin)
            seen[bit, 0, at], seen[bit, 1, at] = (all_ - ones)[run], ones[run]
            head = head | np.concatenate([[True], value[1:] != value[:-1]])
        same, depth = ~head, depth + 1
        longer = sizes[alive] > depth
        alive, same = alive[longer], same[longer]  # who ends here is alone: no token begins with another
        if len(same):
            same[0] = False
    for first in (True, False) if wide and tokens else ():
        token = tokens[0 if first else -1]
        names = _beginnings(token).tolist()
        start, stop = 0, len(tokens)
        for length in range(1, len(token)):
            if stop - start > 1:
                start, stop = _run_of(tokens, length, first)
            follows = wide.get(names[length - 1])
            if follows is None or sum(follows.values()) <= weight[start:stop].sum():
                continue
            nodes = np.zeros(512)
            nodes[[256 + b for b in follows]] = list(follows.values())
            for i in range(255, 0, -1):
                nodes[i] = nodes[2 * i] + nodes[2 * i + 1]
            at = starts[start:stop] + length - 1
            byte = flat[at].astype(np.int64)
            for bit in range(8):
                node = (1 << bit) | (byte >> (8 - bit))
                seen[bit, 0, at], seen[bit, 1, at] = nodes[2 * node], nodes[2 * node + 1]
    return seen


def contexts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes behind the shapes of tokens one after the other, where each token starts, and hashed contexts (orders x bytes)."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1
    flat = np.frombuffer(b"".join(t[1:] for t in tokens), np.uint8)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    shape = np.repeat(np.fromiter((t[0] for t in tokens), np.uint64, len(tokens)), sizes)
    before = np.zeros((3, len(flat)), np.uint64)
    for k in (1, 2, 3):
        before[k - 1, k:] = flat[:-k].astype(np.uint64) + np.uint64(1) if k < len(flat) else 0
        before[k - 1][place < k] = 0
    one, two, three = before
    keys = (shape * np.uint64(257) + one, (two * np.uint64(257) + one) + np.uint64(1 << 40), ((three * np.uint64(257) + two) * np.uint64(257) + one) + np.uint64(2 << 40))
    return flat, starts, np.stack([(_mixed(k * np.uint64(_A)) >> np.uint64(32)).astype(np.uint32) for k in keys])


def slots(hashes: np.ndarray, partial: np.ndarray) -> np.ndarray:
    """Slots of one order's contexts, given the bits already known of each byte."""
    mixed = (hashes ^ (partial.astype(np.uint32) * np.uint32(0x9E3779B1))) * np.uint32(0x85EBCA6B)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOTS)


def partial_bytes(flat: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits already known of each byte, and the next one."""
    return (1 << bit) | (flat.astype(np.int64) >> (8 - bit)), (flat >> np.uint8(7 - bit)) & np.uint8(1)


def _parts(tokens: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of tokens of about ``TOGETHER`` bytes."""
    start, size = 0, 0
    for stop, token in enumerate(tokens, 1):
        size += len(token)
        if size >= TOGETHER or stop == len(tokens):
            yield start, stop
            start, size = stop, 0


@dataclass
class Bytes:
    """The model of a word's bytes, given its shape: hashed counts (orders x slots; zeros real, ones imaginary) and the mixer."""

    counts: np.ndarray
    mixer: Mixer

    @staticmethod
    def new(counts: np.ndarray) -> Bytes:
        """A model that has learned nothing but the counts (orders x slots x bit)."""
        return Bytes(np.ascontiguousarray(counts, np.float32).view(np.complex64)[..., 0], Mixer.new(ORDERS + 1, 16, 256))

    @staticmethod
    def inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions and the gate, from counts (orders x bytes)."""
        return odds(zeros, ones), level(zeros[-1] + ones[-1]) * 4 + level(zeros[-2] + ones[-2])

    def bits(self, flat: np.ndarray, hashes: np.ndarray, beginnings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each bit of some bytes: counts of zeros and of ones (orders x bytes), the bits, and what is known of the bytes."""
        for bit in range(8):
            partial, value = partial_bytes(flat, bit)
            zeros, ones = np.empty((ORDERS + 1, len(flat)), np.float32), np.empty((ORDERS + 1, len(flat)), np.float32)
            for k in range(ORDERS):
                pair = self.counts[k].take(slots(hashes[k], partial), mode="clip")
                zeros[k], ones[k] = pair.real, pair.imag
            zeros[-1], ones[-1] = beginnings[bit]
            yield zeros, ones, value, partial

    def learn(self, tokens: list[bytes], n: np.ndarray, beginnings: np.ndarray) -> None:
        """One online step over tokens that occur ``n`` times each and that the counts include."""
        flat, starts, hashes = contexts(tokens)
        times = np.repeat(n.astype(np.float32), np.diff(np.append(starts, len(flat))))
        for zeros, ones, value, partial in self.bits(flat, hashes, beginnings):
            self.mixer.learn(*self.inputs(*without_own(zeros, ones, value)), partial, value, times)

    def price(self, tokens: list[bytes], beginnings: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each token, and without one own occurrence where ``own`` is set."""
        flat, starts, hashes = contexts(tokens)
        likely = np.ones((2, len(flat)))  # of a byte: eight bits of 1e-5 or more
        for zeros, ones, value, partial in self.bits(flat, hashes, beginnings):
            for k, counts in enumerate(((zeros, ones), without_own(zeros, ones, value))):
                p = self.mixer.final(*self.inputs(*counts), partial)
                likely[k] *= np.where(value == 1, p, 1 - p)
        out = np.add.reduceat(np.log10(likely), starts, axis=1)
        return out[0], np.where(own, out[1], out[0])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, dict[int, dict[int, float]]]]:
    """Tokens with their space, counts and border counts of the ranges in ``words, n, wide``."""
    for batch in batches:
        for row in _rows(batch):
            yield _range(row["words"], row["n"], row["wide"])


def _range(words: bytes, n: bytes, wide: list[dict] | None) -> tuple[list[bytes], np.ndarray, dict[int, dict[int, float]]]:
    own: dict[int, dict[int, float]] = {}
    for item in wide or []:
        own.setdefault(item["name"], {})[item["byte"]] = item["n"]
    return [w + b" " for w in _unpacked_text(words)], unpacked(n, np.int64), own


def _with_wide(ranges: DataFrame) -> DataFrame:
    """``range, words, n, wide``: each range with the counts over all ranges of the beginnings of its first and last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                value, own = row["range"], border_counts([w + b" " for w in _unpacked_text(row["words"])], unpacked(row["n"], np.int64))
                rows = [(name, b, times) for name, counts in own.items() for b, times in counts.items() if times]
                names = [r[0] for r in rows] + list(own)  # a name without counts is asked for as well
                columns = [[value] * len(names), names, [r[1] for r in rows] + [None] * len(own), [r[2] for r in rows] + [None] * len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["range", "name", "byte", "n"])

    edges = cut(ranges.select("range", "words", "n").mapInArrow(run, "range long, name long, byte int, n double"))
    total = edges.where("byte is not null").groupBy("name", "byte").agg(F.sum("n").alias("n"))
    shared = edges.select("range", "name").distinct().join(total, "name").groupBy("range").agg(F.collect_list(F.struct("name", "byte", "n")).alias("wide"))  # two words' beginnings
    return ranges.select("range", "words", "n").join(shared, "range", "left")


def _counted(ranges: DataFrame) -> np.ndarray:
    """The hashed counts over all training words."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tokens, n, _ in _ranges(iter([batch])):
            learned = np.flatnonzero(n > 0)
            tokens, n = [tokens[i] for i in learned], n[learned]
            for start, stop in _parts(tokens):
                flat, starts, hashes = contexts(tokens[start:stop])
                times = np.repeat(n[start:stop], np.diff(np.append(starts, len(flat))))
                for bit in range(8):
                    partial, value = partial_bytes(flat, bit)
                    for k in range(ORDERS):
                        yield ((k << SLOTS) + slots(hashes[k], partial).astype(np.int64)) * 2 + value, times

    return _summed(ranges, ORDERS << (SLOTS + 1), each).reshape(ORDERS, 1 << SLOTS, 2)


def _units(ranges: DataFrame) -> DataFrame:
    """``range, words, n``: the words of the ranges, dealt anew by borders that follow from the distinct words alone.

    Ranges depend on how texts fell into blocks. Borders of units are quantiles of the ``KEPT`` words of lowest hash.
    """

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: list[tuple[int, bytes]] = []
        kinds = 0
        for batch in batches:
            for row in _rows(batch):
                own = _unpacked_text(row["words"])
                kinds += len(own)
                low = heapq.nsmallest(KEPT, [*low, *((xxhash.xxh64_intdigest(w) >> 1, w) for w in own)])
        columns = [[*(h for h, _ in low), None], [*(w for _, w in low), None], [*[0] * len(low), kinds]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["hash", "word", "kinds"])

    some = cut(ranges.select("words").mapInArrow(sampled, "hash long, word binary, kinds long"))
    kinds = some.agg(F.sum("kinds")).first()[0] or 0
    parts = max(1, -(-kinds // UNIT))
    words = sorted(bytes(r.word) + b" " for r in some.where("word is not null").orderBy("hash", "word").limit(KEPT).collect())
    borders = sorted({words[i * len(words) // parts] for i in range(1, parts)})
    drop(some)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own, n = _unpacked_text(row["words"]), unpacked(row["n"], np.int64)
                cuts = [0, *(bisect.bisect_left(own, b, key=lambda w: w + b" ") for b in borders), len(own)]
                kept = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
                columns = [kept, [row["range"]] * len(kept), [_packed_text(own[cuts[i] : cuts[i + 1]]) for i in kept], [packed(n[cuts[i] : cuts[i + 1]]) for i in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["unit", "range", "words", "n"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _grouped(batches):
            words, n = [w for r in rows for w in _unpacked_text(r["words"])], np.concatenate([unpacked(r["n"], np.int64) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array([unit]), pa.array([_packed_text(words)]), pa.array([packed(n)])], ["range", "words", "n"])

    slices = ranges.select("range", "words", "n").mapInArrow(split, "unit long, range long, words binary, n binary")
    return slices.repartition(len(borders) + 1, "unit").sortWithinPartitions("unit", "range").mapInArrow(joined, "range long, words binary, n binary")


def fit_bytes(ranges: DataFrame) -> Bytes:
    """The model of bytes: counts, then one online pass over the training words of each unit, averaged by their tokens.

    Units follow from the words alone, and the average is a sum of integers, so that neither files nor tasks nor their order count.
    """
    counts = _counted(ranges)
    units = cut(_with_wide(_units(ranges)))
    shared = ranges.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n, wide in _ranges(batches):
            own = Bytes.new(shared.value)
            beginnings = counted_beginnings(tokens, n, wide)
            places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1)])
            learned = np.random.default_rng(0).permutation(np.flatnonzero(n > 0))
            for i in range(0, len(learned), 2_000):
                some = np.sort(learned[i : i + 2_000])
                sizes = places[some + 1] - places[some]
                bytes_ = np.arange(sizes.sum()) + np.repeat(places[some + 1] - np.cumsum(sizes), sizes)
                own.learn([tokens[k] for k in some], n[some], beginnings[:, :, bytes_])
            both = np.concatenate([own.mixer.weights.ravel(), own.mixer.refined.ravel()]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([np.rint(both * PARTS_OF_ONE).astype(np.int64)], pa.list_(pa.int64()))], ["seen", "x"])

    model = Bytes.new(counts)
    size, refined = model.mixer.weights.size, model.mixer.refined.size
    flat = units.mapInArrow(run, "seen long, x array<long>").where("seen > 0")
    weighed = F.sum(F.col("x").cast("decimal(18,0)") * F.col("seen").cast("decimal(18,0)"))
    mean = flat.select("seen", F.posexplode("x").alias("i", "x")).groupBy("i").agg((weighed.cast("double") / F.sum("seen") / PARTS_OF_ONE).alias("x")).orderBy("i").toArrow()
    drop(units)
    if mean.num_rows == size + refined:
        x = mean.column("x").to_numpy().astype(np.float32)
        model.mixer.weights, model.mixer.refined = x[:size].reshape(model.mixer.weights.shape), x[size:].reshape(model.mixer.refined.shape)
    return model


# ---- shapes and repeats: bits over counts of bounded contexts ---------------------------------------------------------


def _trees(counts: np.ndarray) -> np.ndarray:
    """Counts over the last axis as sums over nodes of a binary tree: node 1 is all, leaves come last."""
    width = counts.shape[-1]
    nodes = np.zeros((*counts.shape[:-1], 2 * width))
    nodes[..., width:] = counts
    for i in range(width - 1, 0, -1):
        nodes[..., i] = nodes[..., 2 * i] + nodes[..., 2 * i + 1]
    return nodes


def shape_prices(counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each key of ``shape_keys`` (of its shape, given the rest), from training counts."""
    full = counts.astype(np.float64).reshape(STATES, SHAPES, SHAPES, SHAPES)
    trees = [_trees(c) for c in (full.sum(axis=(1, 2)), full.sum(axis=(0, 1)), full.sum(axis=0), full)]
    mixer = Mixer.new(4, 16, SHAPES)

    def bits(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        state, two, one, own = keys // SHAPES**3, keys // SHAPES**2 % SHAPES, keys // SHAPES % SHAPES, keys % SHAPES
        for bit in range(6):
            node = (1 << bit) | (own >> (6 - bit))
            rows = ((trees[0], (state,)), (trees[1], (one,)), (trees[2], (two, one)), (trees[3], (state, two, one)))
            zeros, ones = (np.stack([t[(*at, 2 * node + k)] for t, at in rows]).astype(np.float32) for k in (0, 1))
            yield zeros, ones, (own >> (5 - bit)) & 1, node

    keys = np.random.default_rng(0).permutation(np.flatnonzero(counts))
    for start in range(0, len(keys), 2_000):
        own = keys[start : start + 2_000]
        for zeros, ones, value, node in bits(own):
            mixer.learn(*Bytes.inputs(*without_own(zeros, ones, value)), node, value, counts[own])
    out = np.zeros(len(counts))
    for start in range(0, len(counts), SHAPES**2 * 16):
        own = np.arange(start, min(start + SHAPES**2 * 16, len(counts)))
        for zeros, ones, value, node in bits(own):
            p = mixer.final(*Bytes.inputs(zeros, ones), node)
            out[own] += np.log10(np.where(value == 1, p, 1 - p))
    return out


def repeat_prices(counts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each repeat bit (contexts x bit), from training counts of the same form."""
    seen = counts.reshape(5, 6, 2).astype(np.float32)
    known, history = np.divmod(np.arange(REPEATS), 6)
    rows = np.stack([seen.sum(axis=1)[known], seen.sum(axis=0)[history], seen[known, history]]) + np.float32(0.5)  # orders x contexts x bit
    mixer = Mixer.new(3, 6, REPEATS)
    at, value = np.nonzero(counts.reshape(REPEATS, 2))
    for _ in range(200):
        if len(at):
            mixer.learn(odds(*without_own(rows[:, at, 0], rows[:, at, 1], value)), history[at], at, value, counts.reshape(REPEATS, 2)[at, value])
    p = mixer.final(odds(rows[..., 0], rows[..., 1]), history, np.arange(REPEATS))
    return np.log10(np.stack([1 - p, p], axis=1)).ravel()


# ---- passages --------------------------------------------------------------------------------------------------------


def _answered_keys(table: DataFrame, asked: int) -> DataFrame:
    """``block, range, keys``: for each block and range the training counts of the block's keys, in their order."""
    bits = max(0, (-(-asked // KEYS) - 1).bit_length())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                block, own, times = row["block"], np.cumsum(unpacked(row["keys"], np.uint64)), unpacked(row["seen"], np.uint32)
                cuts = np.searchsorted(own, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(56 - bits))
                cuts = [0, *cuts.tolist(), len(own)]
                some = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
                columns = [some, [block] * len(some), [_ascending(own[cuts[i] : cuts[i + 1]]) for i in some], [packed(times[cuts[i] : cuts[i + 1]]) for i in some]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "keys", "seen"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in _grouped(batches):
            own = [np.cumsum(unpacked(r["keys"], np.uint64)) for r in rows]
            at = np.unique(np.concatenate(own), return_inverse=True)[1]
            total = np.bincount(at, np.concatenate([unpacked(r["seen"], np.uint32) for r in rows]))[at].astype(np.uint32)
            answers = map(packed, np.split(total, np.cumsum([len(k) for k in own])[:-1]))
            columns = [[r["block"] for r in rows], [value] * len(rows), list(answers)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["block", "range", "keys"])

    slices = table.select("block", "keys", "seen").mapInArrow(split, "range long, block long, keys binary, seen binary")
    return slices.repartition(1 << bits, "range").sortWithinPartitions("range", "block").mapInArrow(answer, "block long, range long, keys binary")


def _answered_words(merged: DataFrame, ranges: DataFrame, model: Bytes) -> DataFrame:
    """``block, range, price, again, n``: prices of the words of each block and range, for held-out and for training texts, and counts."""
    shared = merged.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices: tuple[np.ndarray, ...] = ()
        for batch in batches:
            out = []
            for row in _rows(batch):
                if row["words"] is not None:
                    tokens, n, wide = _range(row["words"], row["n"], row["wide"])
                    beginnings = counted_beginnings(tokens, n, wide)
                    ends = np.cumsum([len(t) - 1 for t in tokens])
                    found = [shared.value.price(tokens[a:b], beginnings[:, :, ends[a] - len(tokens[a]) + 1 : ends[b - 1]], n[a:b] > 0) for a, b in _parts(tokens)]
                    prices = (*(np.concatenate(x).astype(np.float32) for x in zip(*found, strict=True)), n)
                else:
                    at = np.cumsum(unpacked(row["at"], np.uint32))
                    out.append((row["block"], row["range"], *(packed(p[at]) for p in prices)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["block", "range", "price", "again", "n"])

    places = merged.where("block is not null").select("range", "block", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("n"), "at", F.lit(None).cast(ranges.schema["wide"].dataType).alias("wide"))
    both = ranges.select("range", F.lit(None).cast("long").alias("block"), "words", "n", F.lit(None).cast("binary").alias("at"), "wide").union(places)
    dealt = both.repartition("range").sortWithinPartitions("range", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(run, "block long, range long, price binary, again binary, n binary")


# ---- scores ----------------------------------------------------------------------------------------------------------


def _history(status: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How the repeat bits before each passage came out: 0 at a start, 1 none told, 2 a miss, 3 to 5 hits in a row.

    ``status``: 0 none told, 1 a miss, 2 a hit.
    """
    at = np.arange(len(status))
    broken = np.maximum.accumulate(np.where(first | (np.concatenate([[0], status[:-1]]) != 2), at, 0))
    row = at - broken
    before = np.concatenate([[0], status[:-1]])
    return np.where(first, 0, np.where(before == 2, np.minimum(row, 3) + 2, before + 1))


def _told(row: dict, price: np.ndarray, again: np.ndarray, n: np.ndarray, seen: np.ndarray, shape_price: np.ndarray) -> dict[str, np.ndarray]:
    """What each document of a block costs, apart from its repeat bits, and those bits as counts by context."""
    words = _unpacked_text(row["words"])
    plain = [w[1:] for w in words]
    sizes, train = unpacked(row["sizes"], np.uint32).astype(np.int32), ~np.array(row["held_out"], bool)
    count = len(sizes)
    seq, owner, starts = sequence(unpacked(row["codes"], np.uint32).astype(np.int64), sizes, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    leads = np.frombuffer(b"".join(words), np.uint8)[np.cumsum(lengths) - lengths]
    kinds = np.append(leads.astype(np.int32) - 64, np.int32(END))
    cut_ = passages(seq, owner, word_hashes(plain))
    own = train[cut_.owner]
    before, both = seen[cut_.before] - own, seen[cut_.both] - own
    status = np.where(before > 0, np.where(both > 0, 2, 1), 0)
    first = np.concatenate([[True], np.diff(cut_.owner) != 0]) if len(own) else np.empty(0, bool)
    context = np.digitize(before, (2, 3, 5, 9)) * 6 + _history(status, first) if len(own) else np.empty(0, np.int64)
    hit, coded = status == 2, status > 0
    flags = np.bincount((cut_.owner * REPEATS + context)[coded] * 2 + hit[coded], minlength=count * REPEATS * 2).reshape(count, -1)
    repeated = np.repeat(hit, np.diff(np.append(cut_.starts, len(seq))))
    prices = np.where(train[owner], np.append(again, 0.0)[seq], np.append(price, 0.0)[seq]) + shape_price[shape_keys(kinds[seq], owner, starts)]
    spelled = np.bincount(owner, np.where(repeated, 0.0, prices), count)
    spelled += np.bincount(cut_.owner[hit], np.log10(both[hit] / before[hit]), count)
    bytes_ = np.bincount(owner, np.append(lengths, 1)[seq], count)  # shape stands for the space
    return {"told": spelled, "bytes": bytes_.astype(np.int64), "flags": flags, "seq": seq, "owner": owner, "n": np.append(n, 0)}


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte (of its tokens).

    ``base_score`` is the unigram estimate (c + 0.5) / (N + 0.5 (V + 1)), ``score`` the model's log10 probability.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table = cut(_blocks(rows))
    blocks, entries, asked, ends = table.agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("entries", "asked", "ends")]).first()
    merged = cut(_merged(table, _borders(table, entries, blocks)))
    words, kinds = merged.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    ranges = cut(_with_wide(merged.where("block is null")))
    model = fit_bytes(ranges)
    shape_counts = _summed(
        table.select("shape", "shapes"), STATES * SHAPES**3, lambda batch: ((np.cumsum(unpacked(r["shape"], np.uint32)), unpacked(r["shapes"], np.uint32)) for r in _rows(batch))
    )
    shape_price = table.sparkSession.sparkContext.broadcast(shape_prices(shape_counts).astype(np.float32))  # of fixed size
    tokens, distinct = words + ends, kinds + (1 if ends else 0)
    norm = float(np.log10(tokens + 0.5 * (distinct + 1)))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, told double, bytes long, flags array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _grouped(batches):
            row = next(r for r in found if r["words"] is not None)
            answers = [r for r in found if r["price"] is not None]
            price, again = (np.concatenate([np.empty(0), *(unpacked(r[c], np.float32) for r in answers)]) for c in ("price", "again"))
            n = np.concatenate([np.empty(0, np.int64), *(unpacked(r["n"], np.int64) for r in answers)])
            seen = np.concatenate([np.empty(0, np.int64), *(unpacked(r["keys"], np.uint32).astype(np.int64) for r in found if r["keys"] is not None)])
            told = _told(row, price, again, n, seen, shape_price.value)
            own = told["n"].copy()
            own[-1] = ends
            count = len(row["doc_id"])
            sums = [np.bincount(told["owner"], x[told["seq"]], count) for x in (np.ones(len(own)), own > 0, np.log10(own + 0.5) - norm)]
            columns = [row["doc_id"], row["held_out"], sums[0].astype(np.int64), sums[1].astype(np.int64), sums[2], told["told"], told["bytes"], list(told["flags"])]
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    asked_words, asked_keys = _answered_words(merged, ranges, model), _answered_keys(table, asked)
    columns = {"words": "binary", "sizes": "binary", "codes": "binary", "doc_id": "array<bigint>", "held_out": "array<boolean>", "range": "bigint", "price": "binary", "again": "binary", "n": "binary", "keys": "binary"}
    parts = [(0, table.select("block", "words", "sizes", "codes", "doc_id", "held_out")), (1, asked_words), (2, asked_keys)]
    same = [df.select("block", F.lit(k).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]) for k, df in parts]
    both = same[0].union(same[1]).union(same[2]).repartition("block").sortWithinPartitions("block", "kind", "range")
    told = cut(both.mapInArrow(combine, schema))
    for used in (table, merged, ranges):
        drop(used)
    flags = told.where("not held_out").agg(*[F.coalesce(F.sum(F.col("flags")[i]), F.lit(0)).alias(f"f{i}") for i in range(2 * REPEATS)]).first()
    costs = F.array(*[F.lit(float(c)) for c in repeat_prices(np.array(flags, np.float64))])
    repeats = F.aggregate(F.zip_with("flags", costs, lambda n, c: n * c), F.lit(0.0), lambda s, x: s + x)
    scored = told.withColumn("score", F.col("told") + repeats)
    bits = (-F.col("score") * float(np.log2(10)) / F.col("bytes")).alias("bits_per_byte")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"), "base_score", "score", bits)
