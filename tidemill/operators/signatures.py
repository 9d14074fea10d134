"""Log-signatures of sliding windows of events: state channels, windows, lead-lag paths, truncated tensor algebra.

Events are indexed; a task gets a block of positions with the rows that its last windows need, so an event is shipped once or
twice, not once for each window that holds it.  Windows share their work: the signature of a path is the product of its steps',
and products over 2, 4, 8 ... steps are made once for all windows and for all lengths.  Scaling a channel scales the words that
hold it, so that each window's own least and greatest values come in at the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.order import blocked, over, unblocked
from tidemill.operators.rolling import frame

CHANNELS = ("p", "sigma", "h", "u")


def state_channels(events: DataFrame, theta: float | Column = 0.002, aggression: float | Column = 2.0) -> DataFrame:
    """Per event: log price from the first, threshold in units of its fractal part, Hurst exponent, log seconds since the last.

    Where scales differ in ``theta`` and ``aggression``, these are columns over the events.
    """
    first = events.groupBy("asset", "scale").agg(F.min_by(F.log(F.col("price") + 1e-10), "i").alias("_first"))
    rows = blocked(events.withColumn("_key", F.concat_ws("|", "asset", "scale")), back=1)
    since = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag("ts").over(over("_key")), F.col("ts")) / 1e6, F.lit(1.0))
    rows = unblocked(rows.withColumn("_since", since)).drop("_key").join(first, ["asset", "scale"])
    penalty = F.exp(aggression * (0.5 - F.col("hurst_snapshot")))
    return rows.select(
        "asset", "scale", "i", "ts", "price", "theta_dynamic", "hurst_snapshot", (F.log(F.col("price") + 1e-10) - F.col("_first")).cast("float").alias("p"),
        (F.col("theta_dynamic") / (theta * penalty + 1e-10)).cast("float").alias("sigma"), F.col("hurst_snapshot").cast("float").alias("h"), F.log(F.col("_since") + 1e-6).cast("float").alias("u"),
    )


def windows(states: DataFrame, length: int, stride: int = 1) -> DataFrame:
    """Full windows of ``length`` events: their place, ends, mean Hurst exponent and threshold, and the states as an array."""
    rows = blocked(states.withColumn("_key", F.concat_ws("|", "asset", "scale")), ahead=length)
    w = over("_key").rowsBetween(0, length - 1)
    rows = rows.select("*", F.collect_list(F.struct(*CHANNELS)).over(w).alias("states"), *[f.over(w).alias(k) for k, f in {"end_idx": F.last("i"), "end_ts": F.last("ts"), "end_price": F.last("price"), "mean_hurst": F.avg("hurst_snapshot"), "mean_theta_dynamic": F.avg("theta_dynamic")}.items()])
    kept = unblocked(rows).where((F.size("states") == length) & (F.col("i") % stride == 0))
    return kept.select("asset", "scale", F.col("i").alias("start_idx"), "end_idx", F.col("ts").alias("start_ts"), "end_ts", F.col("price").alias("start_price"), "end_price", "mean_hurst", "mean_theta_dynamic", "states")


def min_max(found: DataFrame) -> DataFrame:
    """Windows with each channel scaled to its own least and greatest value."""
    def scale(c: str):
        values = F.transform("states", lambda s: s[c].cast("double"))
        low, high = F.array_min(values), F.array_max(values)
        return F.transform(values, lambda x: (x - low) / (high - low + 1e-8)).alias(c)

    return found.select("asset", "scale", "start_idx", *[scale(c) for c in CHANNELS])


def lead_lag(scaled: DataFrame) -> DataFrame:
    """The path of each window: its points twice, the lead one step before the lag (2 L - 1 points of 8 channels)."""
    n = F.size("p")
    steps = F.sequence(F.lit(0), 2 * n - 2)
    at = lambda c, k: F.element_at(F.col(c), k + 1)
    lag, lead = lambda k: F.floor(k / 2).cast("int"), lambda k: F.ceil(k / 2).cast("int")
    path = F.transform(steps, lambda k: F.array(*[at(c, lag(k)) for c in CHANNELS], *[at(c, lead(k)) for c in CHANNELS]))
    return scaled.select("asset", "scale", "start_idx", path.alias("path"))


def level_two(paths: DataFrame) -> DataFrame:
    """Log-signature to depth 2 by closed form: increments, then areas of all channel pairs; word by word."""
    point = lambda k, c: F.element_at(F.element_at(F.col("path"), k), c)
    n = F.size("path")
    first = [(point(n, c) - point(1, c)).alias(f"w{c}") for c in range(1, 9)]

    def area(a: int, b: int):
        def add(total, k):
            xa, xb = point(k, a) - point(1, a), point(k, b) - point(1, b)
            return total + 0.5 * (xa * (point(k + 1, b) - point(k, b)) - xb * (point(k + 1, a) - point(k, a)))

        return F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), add).alias(f"w{a}{b}")

    return paths.select("asset", "scale", "start_idx", *first, *[area(a, b) for a in range(1, 9) for b in range(a + 1, 9)])


@functools.cache
def lyndon(letters: int, depth: int) -> list[tuple[int, ...]]:
    """Words that are less than all their rotations, by length, then in order."""
    found, word = [], [-1]
    while word:
        word[-1] += 1
        found.append(tuple(word))
        size = len(word)
        while len(word) < depth:
            word.append(word[len(word) - size])
        while word and word[-1] == letters - 1:
            word.pop()
    return sorted(found, key=lambda w: (len(w), w))


Levels = list[np.ndarray]


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), a.shape[1] * b.shape[1])


def _segments(steps: np.ndarray, depth: int) -> Levels:
    """Signatures of straight segments (segments x channels), level by level from 1."""
    levels = [steps]
    for k in range(2, depth + 1):
        levels.append(_outer(levels[-1], steps) / k)
    return levels


def _product(a: Levels, b: Levels) -> Levels:
    """Chen's product: signatures of paths put one behind the other."""
    return [x + y + sum((_outer(a[j], b[k - j - 1]) for j in range(k)), np.zeros_like(x)) for k, (x, y) in enumerate(zip(a, b, strict=True))]


def _part(levels: Levels, start: int, size: int) -> Levels:
    return [x[start : start + size] for x in levels]


def _log(levels: Levels, channels: int) -> np.ndarray:
    """Logarithms of signatures, as the numbers of the Lyndon words."""
    depth = len(levels)
    total = [np.zeros_like(x) for x in levels]
    power = list(levels)
    for n in range(1, depth + 1):
        for k in range(depth):
            total[k] += (-1) ** (n + 1) / n * power[k]
        power = [sum((_outer(power[j], levels[k - j - 1]) for j in range(k)), np.zeros_like(levels[k])) for k in range(depth)]
    words = lyndon(channels, depth)
    places = [[sum(c * channels ** (k - 1 - i) for i, c in enumerate(w)) for w in words if len(w) == k] for k in range(1, depth + 1)]
    return np.concatenate([x[:, p] for x, p in zip(total, places, strict=True)], axis=1)


def log_signature(paths: np.ndarray, depth: int) -> np.ndarray:
    """Log-signatures (paths x words) of piecewise linear paths (paths x points x channels)."""
    steps = np.diff(paths, axis=1).transpose(1, 0, 2)
    found = _segments(np.zeros_like(paths[:, 0]), depth)
    for step in steps:
        found = _product(found, _segments(step, depth))
    return _log(found, paths.shape[2])


def window_log_signatures(points: np.ndarray, lengths: tuple[int, ...], depth: int) -> dict[int, np.ndarray]:
    """Log-signatures of the scaled lead-lag paths of all windows of each length over ``points`` (points x channels), a row a start."""
    count, own = points.shape
    moves = np.diff(points, axis=0)
    still = np.zeros_like(moves)
    # Between two points the lead (the second half of the channels) moves first, then the lag.
    power = _product(_segments(np.concatenate([still, moves], axis=1), depth), _segments(np.concatenate([moves, still], axis=1), depth))
    whole: dict[int, Levels] = {}
    done = dict.fromkeys(lengths, 0)
    size = 1
    while size <= max(lengths) - 1:
        for length in lengths:
            if (length - 1) & size and count >= length:
                starts = count - length + 1
                here = _part(power, done[length], starts)
                whole[length] = _product(_part(whole[length], 0, starts), here) if done[length] else here
                done[length] += size
        power = _product(_part(power, 0, max(0, len(power[0]) - size)), _part(power, size, len(power[0])))
        size *= 2
    words = lyndon(2 * own, depth)
    found = {}
    for length in lengths:
        starts = max(0, count - length + 1)
        if not starts or length < 2:
            found[length] = np.zeros((starts, len(words)))
            continue
        view = np.lib.stride_tricks.sliding_window_view(points, length, axis=0)
        scale = 1 / (view.max(axis=2) - view.min(axis=2) + 1e-8)
        found[length] = _log(whole[length], 2 * own) * np.stack([np.prod([scale[:, c % own] for c in w], axis=0) for w in words], axis=1)
    return found


def enough(events: DataFrame, length: int) -> DataFrame:
    """``events``, or an error that names the series and scales with fewer than ``length`` events."""
    short = events.groupBy("asset", "scale").count().where(F.col("count") < length).limit(20).collect()
    if short:
        raise ValueError("too few events: " + ", ".join(f"{r.asset} {r.scale}: {r['count']}" for r in short))
    return events


def signature_windows(states: DataFrame, lengths: tuple[int, ...], depth: int, stride: int = 1, batch: int = 256) -> DataFrame:
    """``asset, scale, length, start_idx, end_idx, start_ts, end_ts, signature`` of every full window of each length."""
    keyed = states.withColumn("_key", F.concat_ws("|", "asset", "scale"))
    rows = blocked(keyed.select("asset", "scale", "_key", "i", "ts", *CHANNELS), ahead=max(lengths), block=2_048)
    names = ["asset", "scale", "length", "start_idx", "end_idx", "start_ts", "end_ts", "signature"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("i")
        values, places, times = group[list(CHANNELS)].to_numpy(np.float64), group["i"].to_numpy(), group["ts"].to_numpy()
        own = int(group["_own"].sum())
        frames = []
        for at in range(0, own, batch):
            for length, found in window_log_signatures(values[at : min(own, at + batch) + max(lengths) - 1], lengths, depth).items():
                first = np.arange(at, min(at + len(found), own, at + batch))
                first = first[places[first] % stride == 0]
                last = first + length - 1
                frames.append(pd.DataFrame({
                    "asset": group["asset"].iloc[0], "scale": group["scale"].iloc[0], "length": length, "start_idx": places[first], "end_idx": places[last],
                    "start_ts": times[first], "end_ts": times[last], "signature": list(found[first - at]),
                }))
        return pd.concat(frames) if frames else pd.DataFrame({c: [] for c in names})

    return rows.groupBy("_key", "_block").applyInPandas(run, "asset string, scale string, length int, start_idx long, end_idx long, start_ts timestamp_ntz, end_ts timestamp_ntz, signature array<double>")


def log_signatures(states: DataFrame, length: int, depth: int, stride: int = 1, batch: int = 256) -> DataFrame:
    """``signature`` (one number for each Lyndon word over 8 channels) of every full window."""
    return signature_windows(states, (length,), depth, stride, batch).select("asset", "scale", "start_idx", F.col("signature").cast("array<float>").alias("signature"))


def invalid(found: DataFrame, depth: int, channels: int = 8) -> DataFrame:
    """Windows whose signature has the wrong length, or a number that is missing or not finite."""
    bad = F.exists("signature", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.where((F.size("signature") != len(lyndon(channels, depth))) | bad)
