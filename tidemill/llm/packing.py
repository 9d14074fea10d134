"""Variable-capacity best-fit packing of token ids into training sequences.

Several sequence lengths are permitted, each with a cost.  A document is its ids and one end; what is longer than the
greatest length is cut into full pieces and a rest, and nothing is dropped.  Pieces are taken longest first.  A piece goes
to the open bin, of any size, that it leaves the least room in; if none has room, the size that costs least for each token
that it could still hold of what remains is opened.  In the end each bin shrinks to the least permitted length that holds
its contents.

Pieces are dealt to shards of bounded size, each packed by itself in one task.  The deal hashes the key, the piece and the
place of the row, so that shards are even also where keys are null or rows repeat; which pieces meet in a bin therefore
depends on how the table is divided.

Defined results: null ids count as none, and take one token, the end; a null key is packed like any other; repeated rows
are packed each; of equal lengths the smaller key, piece and ids come first; a very long document becomes as many pieces as
it needs; other columns are not carried; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths; pieces and tokens of a shard.
CAPACITIES = (512, 1024, 2048, 4096)
PIECES, TOKENS = 16_384, 1 << 23
#: The end of a document among byte ids: no text in UTF-8 holds this byte.
BYTE_END = 255


def cost(capacity: int) -> float:
    """Cost of one sequence: its tokens, attention that grows with its length, and a fixed part."""
    return capacity * (1 + capacity / 16_384) + 64


def byte_ids(text: Column) -> Column:
    """The bytes of a text in UTF-8 as ids of one byte each."""
    return F.encode(text, "UTF-8")


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (given longest first), and the final capacity of each bin."""
    sizes = sorted(capacities)
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # open bins by what room they have
    some = 0  # bit r is set where room[r] has bins
    left, bins, offsets, used = sum(lengths), [], [], []
    for length in lengths:
        fitting = some >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            own = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            size = min((c for c in sizes if c >= length), key=lambda c: (cost(c) / min(c, left), c))
            own, free = len(used), size
            used.append(0)
        bins.append(own)
        offsets.append(used[own])
        used[own] += length
        left -= length
        if free > length:
            room[free - length].append(own)
            some |= 1 << (free - length)
    return bins, offsets, [next(c for c in sizes if c >= u) for u in used]


def pack(
    docs: DataFrame, ids: Column, width: int = 4, end: int = 0, key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, pieces: int = PIECES, tokens: int = TOKENS
) -> DataFrame:
    """A row for each bin: its number, capacity, tokens and ``ids``, and where each piece in it comes from.

    ``ids`` (binary) holds a document's ids as little-endian unsigned integers of ``width`` bytes; ``end`` is put behind.
    ``keys``, ``pieces``, ``starts`` (in the document), ``offsets`` (in the bin) and ``lengths`` belong to each other.
    """
    most = max(capacities)
    closed = F.concat(F.coalesce(ids, F.lit(b"")), F.lit(end.to_bytes(width, "little")))
    sized = docs.select(F.col(key).alias("key"), closed.alias("ids"), F.monotonically_increasing_id().alias("row"))
    total = (F.length("ids") / width).cast("long")
    cuts = sized.select("key", "row", "ids", total.alias("total"), F.posexplode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(most).cast("long"))).alias("piece", "start"))
    length = F.least(F.col("total") - F.col("start"), F.lit(most))
    part = F.substring("ids", (F.col("start") * width + 1).cast("int"), (length * width).cast("int"))
    all_tokens, count = docs.select(((F.length(F.coalesce(ids, F.lit(b""))) / width).cast("long") + 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("n") / most)), F.lit(0))).first()
    shards = max(1, -(-int(count) // pieces), -(-int(all_tokens) // tokens))
    dealt = cuts.select(F.pmod(F.xxhash64("key", "piece", "row"), F.lit(shards)).alias("shard"), "key", "piece", "start", length.alias("length"), part.alias("ids"))
    kind = docs.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        bins, offsets, sizes = best_fit(group.column("length").to_pylist(), capacities)
        order = np.lexsort((offsets, bins))
        group = group.append_column("offset", pa.array(offsets, pa.int64())).take(pa.array(order)).combine_chunks()
        first = np.searchsorted(np.array(bins)[order], np.arange(len(sizes) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(first), _one(group.column(c))) for c in ("key", "piece", "start", "offset", "length")]
        data = _one(group.column("ids")).cast(pa.large_binary())
        held = np.concatenate([[0], np.cumsum(group.column("length").to_numpy())])[first] * width
        joined = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(held.astype(np.int64).tobytes()), data.buffers()[2]])
        number = (int(group.column("shard")[0].as_py()) << 32) + np.arange(len(sizes))
        columns = [pa.array(number), pa.array(sizes, pa.int64()), pa.array(np.diff(held) // width), *lists, joined.cast(pa.binary())]
        return pa.Table.from_arrays(columns, ["bin", "capacity", "n_tokens", "keys", "pieces", "starts", "offsets", "lengths", "ids"])

    schema = f"bin long, capacity long, n_tokens long, keys array<{kind}>, pieces array<int>, starts array<long>, offsets array<long>, lengths array<long>, ids binary"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def placed(bins: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each piece of the bins: key, piece, start, length, bin, capacity and offset."""
    each = bins.select("bin", "capacity", F.explode(F.arrays_zip("keys", "pieces", "starts", "lengths", "offsets")).alias("p"))
    return each.select(F.col("p.keys").alias(key), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), "bin", "capacity", F.col("p.offsets").alias("offset"))
