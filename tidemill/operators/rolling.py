"""Rolling estimates over bars; frames count bars. All run over blocks with a halo (see ``order``)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.guards import clipped, floor_at, full, ratio, root
from tidemill.operators.order import blocked, over, unblocked


def frame(start: int, end: int):
    """Rows from ``start`` to ``end`` around each row."""
    return over().rowsBetween(start, end)


def with_rolling(bars: DataFrame, back: int, ahead: int = 0, **columns: Column) -> DataFrame:
    """Add windowed columns whose frames reach that far."""
    return unblocked(blocked(bars, back, ahead).select("*", *[c.alias(k) for k, c in columns.items()]))


def realized(h: int = 24) -> dict[str, Column]:
    """Realized volatility over the h bars to this one, and over the h bars after it."""
    past, future = frame(1 - h, 0), frame(1, h)
    sums = F.sum("gk_var")
    return {"rv_trail": root(full(sums, F.col("gk_var"), past, h)), "rv_fwd": root(full(sums, F.col("gk_var"), future, h))}


def zscore(window: int = 30, price: str = "close") -> Column:
    """Distance from the mean in population deviations; NULL before the window is full or where nothing moves."""
    rows = frame(1 - window, 0)
    return F.when(F.count(price).over(rows) >= window, ratio(F.col(price) - F.avg(price).over(rows), F.stddev_pop(price).over(rows)))


def moving_average(value: str, window: int) -> Column:
    """Mean of the last rows, of fewer at the start."""
    return F.avg(value).over(frame(1 - window, 0))


def fractal_metrics(bars: DataFrame, theta: float = 0.002, window: int = 30, ref: int = 288, aggression: float = 2.0, gap_minutes: float | None = None) -> DataFrame:
    """Local and reference volatility, energy V, Hurst exponent H, penalty F and threshold, all of the row before.

    A row after a gap of more than ``gap_minutes`` has no return and no differences (gap mode ``exclude``).
    """
    rows = blocked(bars, window + ref + 4)
    w = over()
    before = F.lag("ts").over(w)
    gap = F.coalesce(F.timestamp_diff("MICROSECOND", before, F.col("ts")) > (gap_minutes or 0) * 60_000_000, F.lit(False)) if gap_minutes else F.lit(False)
    rows = rows.withColumn("_gap", gap)
    rows = rows.withColumn("_p", F.when(~F.col("_gap"), F.col("close")))
    rows = rows.select(
        "*",
        F.when(~F.col("_gap"), F.log(F.col("close") / F.lag("close").over(w))).alias("_r"),
        F.abs(F.col("_p") - F.lag("_p").over(w)).alias("_d1"),
        F.abs(F.col("_p") - F.lag("_p", 2).over(w)).alias("_d2"),
    )
    near = frame(1 - window, 0)
    rows = rows.select(
        "*",
        full(F.stddev_samp("_r"), F.col("_r"), near, window).alias("_sigma"),
        full(F.sum("_d1"), F.col("_d1"), near, window).alias("_m1"),
        full(F.sum("_d2"), F.col("_d2"), near, window).alias("_m2"),
    )
    rows = rows.withColumn("_ref", F.avg("_sigma").over(frame(1 - ref, 0)))
    hurst = F.coalesce(clipped(F.log2(floor_at(F.col("_m2") / (F.col("_m1") + 1e-10), 1e-10)), 0.05, 0.95), F.lit(0.5))
    rows = rows.withColumn("_hurst", hurst).withColumn("_v", F.coalesce(F.when(F.col("_ref") > 0, F.col("_sigma") / F.col("_ref")), F.lit(1.0)))
    rows = rows.withColumn("_f", F.exp(aggression * (0.5 - F.col("_hurst")))).withColumn("_theta", theta * F.col("_v") * F.col("_f"))
    last = lambda c, default=None: F.coalesce(F.lag(c).over(w), F.lit(default)) if default is not None else F.lag(c).over(w)
    rows = rows.select(
        *bars.columns, "_block", "_own", F.col("_gap").alias("sampler_gap"), last("_sigma").alias("sigma_t"), last("_ref").alias("sigma_ref"), last("_v", 1.0).alias("energy_v"),
        last("_hurst", 0.5).alias("hurst"), last("_f", 1.0).alias("fractal_f"), last("_theta", theta).alias("theta_dynamic"),
    )
    return unblocked(rows)


def rolling_ou(bars: DataFrame, window: int = 30) -> DataFrame:
    """Rolling AR(1) of log prices as an Ornstein-Uhlenbeck process: theta, half-life, mean, deviation and distance."""
    rows = blocked(bars, window + 1).withColumn("_y", F.log("close"))
    rows = rows.withColumn("_x", F.lag("_y").over(over()))
    near = frame(1 - window, 0)
    n = F.count("_x").over(near)
    rows = rows.select("*", *[(F.when(n >= window, f.over(near))).alias(k) for k, f in {"_b": F.regr_slope("_y", "_x"), "_a": F.regr_intercept("_y", "_x"), "_syy": F.regr_syy("_y", "_x"), "_sxy": F.regr_sxy("_y", "_x")}.items()])
    valid = (F.col("_b") > 0) & (F.col("_b") < 0.999)
    theta = F.when(valid, -F.log("_b"))
    spread = F.greatest((F.col("_syy") - F.col("_b") * F.col("_sxy")) / window, F.lit(1e-12))
    rows = rows.withColumn("_level", F.when(valid, F.col("_a") / (1 - F.col("_b")))).withColumn("ou_theta", theta)
    rows = rows.withColumn("ou_sigma", F.when(F.col("_b") * F.col("_b") < 1, F.sqrt(spread / (1 - F.col("_b") * F.col("_b")))))
    rows = rows.withColumn("ou_half_life", ratio(F.lit(0.6931471805599453), F.col("ou_theta"))).withColumn("ou_mu", F.exp("_level"))
    rows = rows.withColumn("ou_z", ratio(F.col("_y") - F.col("_level"), F.col("ou_sigma")))
    return unblocked(rows).drop("_x", "_y", "_a", "_b", "_syy", "_sxy", "_level")


def power_law(alpha: float | Column, delta: float | Column, n: int) -> Column:
    """Weights (i + delta)^-alpha of lags 1..n, normalised; even ones where their sum is not finite."""
    a, d = (x if isinstance(x, Column) else F.lit(float(x)) for x in (alpha, delta))
    raw = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.pow(i + d, -a))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    good = (total > 0) & (total < float("inf"))
    return F.transform(raw, lambda x: F.when(good, x / total).otherwise(F.lit(1.0 / n)))


def weights(alpha: float, delta: float, n: int) -> list[float]:
    """The same as numbers, for frames whose weights are known when the plan is built."""
    raw = [float(i + delta) ** -float(alpha) for i in range(1, n + 1)]
    total = sum(raw)
    return [x / total for x in raw] if 0 < total < float("inf") else [1.0 / n] * n


def lagged(bars: DataFrame, n: int = 50, value: str = "return") -> DataFrame:
    """``past``: the last n values before each bar, the newest first; missing ones count as 0, short starts are short."""
    past = F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(frame(-n, -1))
    return unblocked(blocked(bars, n).withColumn("past", F.reverse(past)))


def kernel_sums(w1: Column, w2: Column, past: str = "past") -> tuple[Column, Column]:
    """r1 and r2 of each row: sums of its past and of its squares by weights, which may be other ones in each row."""

    def total(own: Column, square: bool) -> Column:
        parts = F.zip_with(past, own, lambda r, w: F.coalesce((r * r if square else r) * w, F.lit(0.0)))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    return total(w1, False), F.greatest(total(w2, True), F.lit(0.0))


def kernel_features(bars: DataFrame, a1: float, d1: float, a2: float, d2: float, n: int = 50, value: str = "return") -> DataFrame:
    """r1 and r2: power-law sums of the last n returns and squared returns, the present bar left out; short starts count as 0."""
    r1, r2 = kernel_sums(*(F.array(*[F.lit(x) for x in weights(a, d, n)]) for a, d in ((a1, d1), (a2, d2))))
    return lagged(bars, n, value).withColumn("r1", r1).withColumn("r2", r2).drop("past")


def all_of(*columns: Column) -> Column:
    """Conjunction of conditions."""
    return functools.reduce(lambda a, b: a & b, columns)
