import itertools
import random
import struct

from pyspark.sql import functions as F

from tidemill.llm import packing

SCHEMA = "doc_id long, text string, bin int, total string"


def plain(lengths, capacities):
    """The same rules by looking at every open bin."""
    bins, left, where = [], sum(lengths), []
    for n in lengths:
        fitting = [i for i, b in enumerate(bins) if b["free"] >= n]
        if fitting:
            least = min(bins[i]["free"] for i in fitting)
            own = max((i for i in fitting if bins[i]["free"] == least), key=lambda i: bins[i]["touched"])
        else:
            size = min((c for c in sorted(capacities) if c >= n), key=lambda c: packing.cost(c) / min(c, left))
            bins.append({"free": size, "used": 0})
            own = len(bins) - 1
        where.append((own, bins[own]["used"]))
        bins[own]["free"] -= n
        bins[own]["used"] += n
        bins[own]["touched"] = len(where)
        left -= n
    return where, [min(c for c in capacities if c >= b["used"]) for b in bins]


def test_against_the_rules_bin_by_bin():
    rng = random.Random(2)
    for _ in range(60):
        capacities = tuple(rng.sample([8, 16, 24, 40, 64], rng.randint(1, 4)))
        lengths = sorted((rng.randint(1, max(capacities)) for _ in range(rng.randint(1, 120))), reverse=True)
        bins, offsets, sizes = packing.best_fit(lengths, capacities)
        where, expected = plain(lengths, capacities)
        assert sizes == expected and list(zip(bins, offsets, strict=True)) == where


def test_several_lengths_cost_no_more_than_any_single_one():
    rng = random.Random(9)
    lengths = sorted((min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)), reverse=True)
    spent = sum(map(packing.cost, packing.best_fit(lengths)[2]))
    assert spent <= sum(map(packing.cost, packing.best_fit(lengths, (4096,))[2]))
    assert sum(packing.best_fit(lengths)[2]) <= 1.05 * sum(lengths)


def least_cost(lengths, capacities):
    """The cheapest bins of all ways to part a few pieces."""

    def ways(rest, bins):
        if not rest:
            yield sum(packing.cost(min(c for c in capacities if c >= sum(b))) for b in bins)
            return
        for i in range(len(bins)):
            if sum(bins[i]) + rest[0] <= max(capacities):
                yield from ways(rest[1:], [*bins[:i], [*bins[i], rest[0]], *bins[i + 1 :]])
        yield from ways(rest[1:], [*bins, [rest[0]]])

    return min(ways(lengths, []))


def test_cost_against_the_optimum_of_a_few_pieces():
    rng = random.Random(4)
    shares = []
    for _ in range(80):
        lengths = sorted((rng.choice([rng.randint(1, 600), rng.randint(1, 4096)]) for _ in range(rng.randint(1, 8))), reverse=True)
        shares.append(sum(map(packing.cost, packing.best_fit(lengths)[2])) / least_cost(lengths, packing.CAPACITIES))
    assert min(shares) >= 1 - 1e-9 and sum(shares) / len(shares) < 1.05 and max(shares) < 1.4


def check(rows, docs, capacities, width, end):
    """Bins hold each document's ids once and in order; ``docs`` is a list of (key, ids)."""
    code = {1: "B", 4: "I"}[width]
    pieces = {}
    assert len({r.bin for r in rows}) == len(rows)
    for r in rows:
        ids = struct.unpack(f"<{len(r.ids) // width}{code}", r.ids)
        assert len(ids) == r.n_tokens == sum(r.lengths) and r.capacity == min(c for c in capacities if c >= r.n_tokens)
        assert r.offsets == [0, *itertools.accumulate(r.lengths)][:-1]
        for key, piece, start, offset, length in zip(r["keys"], r.pieces, r.starts, r.offsets, r.lengths, strict=True):
            pieces.setdefault((key, piece, start), []).append(ids[offset : offset + length])
    expected = {}
    for key, ids in docs:
        own = (*ids, end)
        for piece, start in enumerate(range(0, len(own), max(capacities))):
            expected.setdefault((key, piece, start), []).append(own[start : start + max(capacities)])
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in expected.items()}


def test_bins_give_back_every_document(spark):
    rng = random.Random(1)
    ids = {i: [rng.randrange(50_000) for _ in range(rng.choice([0, 3, 50, 300, 700]))] for i in range(300)} | {999: list(range(9000))}
    rows = [(i, struct.pack(f"<{len(x)}I", *x), 1, "x") for i, x in ids.items()] + [(1000, None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, ids binary, bin int, row string")
    for pieces in (40, 10_000):
        got = packing.pack(docs, F.col("ids"), end=65_535, capacities=(64, 256, 512), pieces=pieces).collect()
        check(got, [*ids.items(), (1000, [])], (64, 256, 512), 4, 65_535)
        assert (len({r.bin >> 32 for r in got}) > 5) == (pieces == 40)
    assert sorted(got) == sorted(packing.pack(docs.repartition(5), F.col("ids"), end=65_535, capacities=(64, 256, 512)).collect())


def test_bytes_of_texts(spark):
    docs = spark.createDataFrame([(1, "añb", 1, None), (2, "x" * 9000, 1, None), (3, "", None, None)], SCHEMA)
    got = packing.pack(docs, packing.byte_ids(F.col("text")), width=1, end=packing.BYTE_END)
    check(got.collect(), [(1, "añb".encode()), (2, b"x" * 9000), (3, b"")], packing.CAPACITIES, 1, 255)
    placed = packing.placed(got).where("doc_id = 2").orderBy("piece").collect()
    assert [(r.start, r.length) for r in placed] == [(0, 4096), (4096, 4096), (8192, 809)]


def test_shards_are_even_for_null_and_repeated_keys(spark):
    rows = [(None, "a", 1, "")] * 2000 + [(7, "same words", 1, "")] * 2000
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), packing.byte_ids(F.col("text")), width=1, end=255, pieces=250).collect()
    shards = {}
    for r in got:
        shards[r.bin >> 32] = shards.get(r.bin >> 32, 0) + len(r.pieces)
    assert sum(shards.values()) == 4000 and len(shards) == 16 and max(shards.values()) < 400


def test_nulls_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1, None), (1, None, None, "x"), (2, "a", 1, "x"), (2, "a", 1, "x")], SCHEMA)
    got = packing.pack(docs, packing.byte_ids(F.col("text")), width=1, end=255).collect()
    check(got, [(None, b"a b"), (1, b""), (2, b"a"), (2, b"a")], packing.CAPACITIES, 1, 255)
    assert [(r.bin, r.capacity, r["keys"]) for r in got] == [(0, 512, [None, 2, 2, 1])]
    assert packing.pack(docs.limit(0), packing.byte_ids(F.col("text")), width=1, end=255).collect() == []
