import math

import numpy as np

from tidemill.llm import hamming

SCHEMA = "vec_id long, embedding array<float>, label int, id long, part string"


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, 5, "x") for v, e in rows], SCHEMA).repartition(3)


def exact(rows, k, every):
    ids = np.array([v for v, _ in rows])
    data = np.array([e for _, e in rows], np.float32).astype(float)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            score = (data * data[i]).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_index_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, size=(500, 3)).astype(np.uint16)
    codes[:50] = codes[0]
    index = hamming.MultiIndex(codes)
    for radius in (0, 3, 10, 17, 24):
        for q in codes[::50]:
            expected = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= radius)
            assert np.array_equal(index.within(q, radius), expected)


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(hamming, "PART", 700)
    rng = np.random.default_rng(5)
    data = rng.normal(size=(2000, 32)) + 1.5 * rng.normal(size=(10, 32))[rng.integers(10, size=2000)]
    data /= np.linalg.norm(data, axis=1)[:, None]
    data[100:160] = data[100]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    found = {}
    for r in hamming.nearest(frame(spark, rows), k=20, every=20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    truth = exact(rows, 20, 20)
    assert found.keys() == truth.keys()
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in truth[q]}) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    for q, got in found.items():
        assert len(got) == 20 and got == sorted(got, key=lambda x: (-x[1], x[0]))
        scores = {v: float((np.float32(data[v]).astype(float) * np.float32(data[q]).astype(float)).sum()) for v, _ in got}
        assert all(math.isclose(s, scores[v], abs_tol=1e-12) for v, s in got)
    assert [v for v, _ in found[100]][:19] == list(range(101, 120))  # copies tie by key


def test_odd_rows_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (20, None), (40, [math.nan, 1.0]), (60, [1.0]), (None, [1.0, 1.0]), (80, [math.inf, 1.0])]
    assert [tuple(r) for r in hamming.nearest(frame(spark, rows)).collect()] == [(0, 1, 1, 0.75)]
    assert hamming.nearest(frame(spark, rows).limit(0)).collect() == []


def test_wide_balls_cost_one_look_at_each_value():
    codes = np.random.default_rng(3).integers(0, 1 << 16, size=(10_000, 32)).astype(np.uint16)
    index = hamming.MultiIndex(codes)
    read = []

    class Starts(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self)[at]

    index.lists = [(order, values, starts.view(Starts), *rest) for order, values, starts, *rest in index.lists]
    for q in codes[:5]:
        expected = np.flatnonzero(np.bitwise_count(codes ^ q).sum(axis=1) <= 194)
        assert np.array_equal(index.within(q, 194), expected)
    assert not read  # balls of 6,885 of 65,536 values are not listed: nearly all values that occur are compared in less time
