import math

import numpy as np
import pytest

from tidemill.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, part string"


def brute(rows, k, every, scale=256):
    good = {v: [math.floor(scale * float(np.float32(x))) for x in e] for v, e in rows if v is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in good:
        if q % every == 0:
            ranked = sorted(((sum(a * b for a, b in zip(good[q], good[v], strict=True)), v) for v in good if v != q), key=lambda x: (-x[0], x[1]))
            out += [(q, i + 1, v, s) for i, (s, v) in enumerate(ranked[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(v, e, 1, 5, "x") for v, e in rows], SCHEMA).repartition(3)


def random_rows(seed, n, dim=6, copies=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    data = centres[rng.integers(5, size=n)] + rng.normal(size=(n, dim)) * 0.3
    data[:copies] = data[0]
    return [(int(i), [float(x) for x in v]) for i, v in zip(rng.permutation(n * 2)[:n], data, strict=True)]


@pytest.mark.parametrize("part", [32, 10_000])
def test_against_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(topk, "PART", part)
    monkeypatch.setattr(topk, "ANNULUS", 7)
    rows = random_rows(3, 300)
    rows += [(1001, None), (1000, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1010, [math.nan] * 6), (1050, [math.inf] + [0.0] * 5), (1100, [0.0] * 6), (None, [1.0] * 6), (1150, [])]
    found = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), k=5, every=5).collect())
    assert found == brute([r for r in rows if r[1] != []], 5, 5)


def test_pruning_skips_parts_yet_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART", 50)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 0.01 + [0, 0, 0] + np.eye(3)[i % 3] * 5]) for i in range(450)]
    sent = []
    original = topk._sent
    monkeypatch.setattr(topk, "_sent", lambda *a: sent.append(original(*a)) or sent[-1])
    found = sorted(tuple(r) for r in topk.top_k(frame(spark, rows), k=3, every=9).collect())
    assert found == brute(rows, 3, 9)
    assert sent[0].count() < 50 * 8  # 50 queries and 9 parts


def test_few_rows_repeated_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (9, [1.0])]
    assert sorted(tuple(r) for r in topk.top_k(frame(spark, rows)).collect()) == [(0, 1, 1, 32768), (0, 2, 2, 32768)]
    assert topk.top_k(frame(spark, rows).limit(0)).collect() == []
    assert vectors.clean(frame(spark, rows).limit(0)).collect() == []
