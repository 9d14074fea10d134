import hashlib
import math

import numpy as np
import pytest

from tidemill.llm import codebooks, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code string, vec int, n int"


def nearest(book, v):
    return min((sum((a - b) ** 2 for a, b in zip(e, v, strict=True)), i) for i, e in enumerate(book))


def brute(rows, parts=4, size=256, rounds=4):
    kept = [(k, [math.floor(1024 * float(np.float32(x))) for x in e], label) for k, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = max([1, *(-(-len(v) // parts) for _, v, _ in kept)])
    cut = [[(v + [0] * (width * parts))[i * width : (i + 1) * width] for i in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:size]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            got = {}
            for row in cut:
                got.setdefault(nearest(book, row[p])[1], []).append(row[p])
            for entry, own in got.items():
                book[entry] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    ends = [[nearest(book, row[p]) for p, book in enumerate(books)] for row in cut]
    errors, by_label = [sum(d for d, _ in e) for e in ends], {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((str(k), "".join(f"{i:02x}" for _, i in e), error, by_label[label], digest) for (k, _, label), e, error in zip(kept, ends, errors, strict=True))


def found(spark, rows, tmp_path):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in queries.op12_vector_codes(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("spread", [0.002, 1.0])  # few different integers give many ties
@pytest.mark.parametrize("shape", [(256, 16), (40, 4), (1, 3)])
def test_tree_search_as_over_all_entries(spread, shape):
    rng = np.random.default_rng(1)
    book = np.floor(1024 * spread * rng.normal(size=shape)).astype(np.int64)
    rows = np.floor(1024 * spread * rng.normal(size=(500, shape[1]))).astype(np.int64)
    which, distance = codebooks.nearest(book, codebooks.tree(book), rows)
    assert list(zip(distance.tolist(), which.tolist(), strict=True)) == [nearest(book.tolist(), r) for r in rows.tolist()]


@pytest.mark.parametrize("hot", [5, 1_000_000])
def test_against_brute_force(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(codebooks, "HOT", hot)
    monkeypatch.setattr(codebooks, "STEP", 50)
    rng = np.random.default_rng(7)
    data = rng.normal(size=(330, 8)) * 0.1
    data[:60] = data[0]
    rows = [(int(i), [float(x) for x in v], [None, 1, 2, 3][i % 4] if i % 3 else 1) for i, v in zip(rng.permutation(990)[:330], data, strict=True)]
    rows += [rows[5], (None, [0.5] * 8, 9), (1, None, 1), (2, [math.nan] * 8, 1), (3, [None] + [0.0] * 7, 1), (4, [math.inf] + [1.0] * 7, 2), (-4, [-0.5] * 8, 2)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_few_short_and_huge_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.0], 1), (2, [], None), (3, [0.25], 2), (4, [0.1] * 9, 2)]
    assert found(spark, rows, tmp_path) == brute(rows)
    assert found(spark, [], tmp_path) == []
    huge = found(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)], tmp_path)
    assert [r[2] for r in huge] == [0, 0, 0]


def test_codes_give_back_vectors_within_their_error(spark):
    rng = np.random.default_rng(2)
    data = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)], "vec_id long, embedding array<float>, label int")
    rows, width = codebooks.scaled(data, 4, 1024)
    books = codebooks.fit(rows, width, size=16)
    whole = {r.vec_id: np.array(r.vec) for r in rows.collect()}
    coded = codebooks.encode(rows, books).collect()
    back = books.vectors(np.array([[int(r.code[i : i + 2], 16) for i in range(0, 8, 2)] for r in coded]))
    assert [((whole[r.vec_id] - b) ** 2).sum() for r, b in zip(coded, back, strict=True)] == [r.error for r in coded]
    assert sum(r.error for r in coded) < sum(r.error for r in codebooks.encode(rows, codebooks.fit(rows, width, size=16, rounds=0)).collect())
