import numpy as np
import pytest

from tidemill.operators import kernels, rolling


def sums(past, a1, d1, a2, d2, n):
    w1, w2 = (np.array(rolling.weights(a, d, n))[: len(past)] for a, d in ((a1, d1), (a2, d2)))
    return float(past @ w1), float(np.sqrt(max(0.0, (past**2) @ w2)))


def solved(rows, params, n):
    x = np.array([[1.0, *sums(p, *params, n)] for p, _ in rows])
    y = np.array([y for _, y in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return beta, 1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def staged(rows, first, factors, n):
    best, candidates = None, list(first)
    for factor in [*factors, None]:
        scores = [(round(solved(rows, c, n)[1], 9), -i) for i, c in enumerate(candidates)]
        best = candidates[-max(scores)[1]]
        if factor is not None:
            candidates = [best]
            for k, (low, high) in enumerate(kernels.BOUNDS):
                for value in (best[k] / factor, best[k] * factor):
                    candidates.append(tuple(min(max(value, low), high) if i == k else x for i, x in enumerate(best)))
    return best, *solved(rows, best, n)


def test_stages_against_plain_least_squares(spark):
    rng, n = np.random.default_rng(2), 6
    rows = []
    for fold in (0, 1):
        for _ in range(80):
            past = rng.normal(size=rng.integers(4, n + 1))
            r1, r2 = sums(past, *((2.0, 1.0, 0.5, 3.0) if fold else (0.5, 8.0, 3.0, 1.0)), n)
            rows.append(("A", fold, [float(x) for x in past], float(0.1 - 0.3 * r1 + 0.5 * r2 + 0.05 * rng.normal())))
    df = spark.createDataFrame(rows, "asset string, fold int, past array<double>, y double").repartition(3)
    first, factors = kernels.grid((0.5, 2.0), (1.0, 10.0)), (2.0, 1.5)
    fit = kernels.fitted(df, ["asset", "fold"], "y", n, first, factors)
    got = {r.fold: r for r in fit.collect()}
    assert sorted(got) == [0, 1]
    for fold, r in got.items():
        params, beta, share = staged([(np.array(p), y) for _, f, p, y in rows if f == fold], first, factors, n)
        assert tuple(r[p] for p in kernels.PARAMETERS) == pytest.approx(params)
        assert (r.b0, r.b1, r.b2, r.in_r2) == (*map(pytest.approx, beta), pytest.approx(share))
    assert got[0].alpha1 != got[1].alpha1
    for r in kernels.with_sums(df, fit, ["asset", "fold"], n).collect():
        assert (r.r1, r.root_r2) == pytest.approx(sums(np.array(r.past), *(r[p] for p in kernels.PARAMETERS), n))


def test_groups_without_spread_have_no_fit(spark):
    df = spark.createDataFrame([("A", 0, [0.0, 0.0], 1.0)] * 5, "asset string, fold int, past array<double>, y double")
    assert kernels.fitted(df, ["asset", "fold"], "y", 2, kernels.grid((1.0,), (1.0,)), (2.0,)).collect() == []
