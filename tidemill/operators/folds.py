"""Walk-forward fits of power-law kernels: one task a fold, global search with the linear part solved inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.joins import admitted, fold_rows, fold_table
from tidemill.operators.regression import RIDGE
from tidemill.operators.rolling import realized, weights, with_rolling

#: Bounds of exponent and shift.
ALPHA, DELTA = (0.1, 10.0), (0.05, 500.0)


def filtered(values: np.ndarray, alpha: float, delta: float, n: int) -> np.ndarray:
    """Causal power-law sum of the n values before each one, by a fast transform; missing values count as 0."""
    kernel = np.concatenate([[0.0], weights(alpha, delta, n)])
    size = 1 << (len(values) + n).bit_length()
    return np.fft.irfft(np.fft.rfft(values, size) * np.fft.rfft(kernel, size), size)[: len(values)]


def solve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Ridge-stabilised least squares, and the share of variance explained."""
    beta = np.linalg.solve(x.T @ x + RIDGE * np.eye(x.shape[1]), x.T @ y)
    total = ((y - y.mean()) ** 2).sum()
    return beta, float(1 - ((y - x @ beta) ** 2).sum() / total) if total > 0 else 0.0


def design(returns: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Regressors 1, r1 and the root of r2."""
    r1, r2 = filtered(returns, p[0], p[1], n), np.maximum(filtered(returns**2, p[2], p[3], n), 0)
    return np.column_stack([np.ones(len(r1)), r1, np.sqrt(r2)])


def search(returns: np.ndarray, y: np.ndarray, n: int, seed: int, rounds: int = 30, size: int = 24, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Kernel parameters by differential evolution (best/1/bin) in logarithms, then a pattern search around the best."""
    low, high = np.log([ALPHA[0], DELTA[0]] * 2), np.log([ALPHA[1], DELTA[1]] * 2)
    rng = np.random.default_rng(seed)
    fit = lambda p: solve(design(returns, np.exp(p), n)[n:], y[n:])[1]
    people = low + (high - low) * (rng.permuted(np.tile(np.arange(size), (4, 1)), axis=1).T + rng.random((size, 4))) / size
    if start is not None:
        people[0] = np.clip(np.log(start), low, high)
    value = np.array([fit(p) for p in people])
    for _ in range(rounds):
        best = people[value.argmax()]
        for i in range(size):
            a, b = people[rng.choice(size, 2, replace=False)]
            trial = np.where(rng.random(4) < 0.7, best + rng.uniform(0.5, 1.0) * (a - b), people[i])
            trial = np.where((trial < low) | (trial > high), low + (high - low) * rng.random(4), trial)
            if (now := fit(trial)) > value[i]:
                people[i], value[i] = trial, now
        if np.ptp(value) < 1e-7:
            break
    best, top = people[value.argmax()].copy(), value.max()
    step = 0.3
    while step > 1e-3:
        moved = False
        for k in range(4):
            for sign in (1, -1):
                trial = best.copy()
                trial[k] = np.clip(trial[k] + sign * step, low[k], high[k])
                if (now := fit(trial)) > top:
                    best, top, moved = trial, now, True
        step = step if moved else step / 2
    params = np.exp(best)
    return params, *solve(design(returns, params, n)[n:], y[n:])


_FOLD = "asset string, fold int, train_start timestamp_ntz, test_start timestamp_ntz, alpha1 double, delta1 double, alpha2 double, delta2 double, b0 double, b1 double, b2 double, beta1_sign int, in_sample_r2 double, a0 double, a1 double"
PREDICTIONS = f"{_FOLD}, ts timestamp_ntz, rv_true double, sigma_hat double, sigma_ar1 double, sigma_naive double, r1 double, r2 double"


def targets(bars: DataFrame, h: int) -> DataFrame:
    """Bars with trailing and forward volatility, rows without either left out."""
    return with_rolling(bars, h, h, **realized(h)).where("rv_fwd is not null and rv_trail is not null")


def walk_forward(bars: DataFrame, h: int = 24, n: int = 500, train: str = "183 days", test: str = "14 days", least: tuple[int, int] = (1000, 100), rounds: int = 30, contiguous: bool = False, max_folds: int | None = None, warm_start: bool = False) -> DataFrame:
    """Out-of-sample forecasts of every fold (of the first ``max_folds``), with its parameters.

    Folds are fitted independently, each in a task; with ``warm_start`` one after the other, each search from the fold's
    before, so that a series is one task. The context of the test rows is the tail of the training rows, or with
    ``contiguous`` the rows just before them.
    """
    rows = targets(bars, h)
    folds = fold_table(rows, train, test, 5 * h)
    members = fold_rows(rows.select("asset", "ts", "return", "rv_fwd", "rv_trail"), folds)
    numbered = admitted(folds, members, n + least[0], least[1]).select("asset", "train_start", "fold")
    if max_folds is not None:
        numbered = numbered.where(F.col("fold") < max_folds)

    def fit(group: pd.DataFrame, start: np.ndarray | None = None) -> pd.DataFrame:
        group = group.sort_values("ts")
        own, later = group[group["part"] == "train"], group[group["part"] == "test"]
        returns, y = own["return"].to_numpy(), own["rv_fwd"].to_numpy()
        fold = int(group["fold"].iloc[0])
        p, beta, r2_in = search(returns, y, n, seed=42 + fold, rounds=rounds, start=start)
        line, _ = solve(np.column_stack([np.ones(len(own) - n), own["rv_trail"].to_numpy()[n:]]), y[n:])
        before = group.loc[group["ts"] < later["ts"].iloc[0], "return"].to_numpy()[-n:] if contiguous else returns[-n:]
        x = design(np.concatenate([before, later["return"].to_numpy()]), p, n)[n:]
        trail = later["rv_trail"].to_numpy()
        constant = {"asset": group["asset"].iloc[0], "fold": fold, "train_start": group["train_start"].iloc[0], "test_start": group["test_start"].iloc[0], "in_sample_r2": r2_in}
        constant |= dict(zip(("alpha1", "delta1", "alpha2", "delta2"), p, strict=True)) | dict(zip(("b0", "b1", "b2"), beta, strict=True)) | {"beta1_sign": int(np.sign(beta[1])), "a0": line[0], "a1": line[1]}
        out = pd.DataFrame({"ts": later["ts"], "rv_true": later["rv_fwd"], "sigma_hat": x @ beta, "sigma_ar1": line[0] + line[1] * trail, "sigma_naive": trail, "r1": x[:, 1], "r2": x[:, 2] ** 2})
        return out.assign(**constant)[[f.split()[0] for f in PREDICTIONS.split(", ")]]

    def fit_all(group: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        for _, own in group.groupby("fold", sort=True):
            before = found[-1].iloc[0][["alpha1", "delta1", "alpha2", "delta2"]].to_numpy(float) if found else None
            found.append(fit(own, before))
        return pd.concat(found)

    rows = members.join(numbered, ["asset", "train_start"])
    return rows.groupBy("asset").applyInPandas(fit_all, PREDICTIONS) if warm_start else rows.groupBy("asset", "fold").applyInPandas(lambda group: fit(group), PREDICTIONS)


def sensitivity(bars: DataFrame, hs: tuple[int, ...], ns: tuple[int, ...], base: tuple[int, int], **options) -> DataFrame:
    """In- and out-of-sample shares explained for each horizon and each kernel length, the other held at its base."""
    from tidemill.operators.regression import errors

    out = None
    for kind, h, n in [("horizon", h, base[1]) for h in hs] + [("length", base[0], n) for n in ns]:
        found = errors(walk_forward(bars, h=h, n=n, **options), ["fold", "in_sample_r2"], "rv_true", {"pdv": "sigma_hat", "ar1": "sigma_ar1"})
        own = found.agg(F.avg("in_sample_r2").alias("in_r2"), F.avg("oos_r2_pdv").alias("oos_r2"), F.avg("oos_r2_ar1").alias("oos_r2_ar1"))
        own = own.select(F.lit(kind).alias("type"), F.lit(h).alias("h"), F.lit(n).alias("n"), "*")
        out = own if out is None else out.unionByName(own)
    return out
