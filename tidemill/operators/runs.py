"""Strategy runs: forecasts or frozen parameters to features, features to gated signals, signals to metrics by configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import backtest, bars, regime, rolling
from tidemill.operators.order import indexed
from tidemill.scratch import kept


def predicted(forecasts: DataFrame, sigma: str = "sigma_pdv") -> DataFrame:
    """Bars with one forecast each, that of the first fold: floored ``sigma_hat``, ``beta1_sign`` and ``r1``."""
    once = bars.distinct_first(forecasts.select("asset", "ts", "close", "fold", F.col(sigma).alias("sigma_hat"), "r1", F.signum("b1").cast("int").alias("beta1_sign")), ["asset", "ts"], ["fold"])
    return once.withColumn("sigma_hat", F.greatest("sigma_hat", F.lit(regime.SIGMA_FLOOR)))


def frozen(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars (with ``r1`` and ``root_r2``) under the parameters of the last fold: one row a series, so the join is a lookup."""
    last = folds.groupBy("asset").agg(F.max_by(F.struct("b0", "b1", "b2"), "fold").alias("_p"))
    sigma = F.col("_p.b0") + F.col("_p.b1") * F.col("r1") + F.col("_p.b2") * F.col("root_r2")
    found = rows.join(last, "asset").withColumn("sigma_hat", F.greatest(sigma, F.lit(regime.SIGMA_FLOOR)))
    return found.withColumn("beta1_sign", F.signum("_p.b1").cast("int")).drop("_p")


def features(rows: DataFrame, h: int = 24, z_window: int = 30, days: int = 60, least: int = 500, share: float = 0.5) -> DataFrame:
    """Regime, transitions from expansion to ranging and z-score of bars with ``close, sigma_hat, r1, beta1_sign``.

    Forecast, z-score and kernel are rounded, so that comparisons do not hang on the last bit.
    """
    placed = indexed(rows.select("asset", "ts", "close", F.round("sigma_hat", 9).alias("sigma_hat"), F.round("r1", 12).alias("r1"), "beta1_sign"))
    scored = rolling.with_rolling(placed, z_window, 0, z_score=rolling.zscore(z_window)).withColumn("z_score", F.round("z_score", 6))
    return regime.since_transition(regime.transitions(regime.gate(scored, days=days, least=least, share=share)), "expansion", "ranging")


def gated(signals: DataFrame, most: int = 48, hurst: DataFrame | None = None, hurst_most: float = 0.6) -> dict[str, DataFrame]:
    """Signals inside the gap after a transition, two-sided and long-only; with ``hurst`` (asset, ts, hurst) only below its bound."""
    rows = signals.join(hurst, ["asset", "ts"], "left") if hurst is not None else signals
    bound = hurst_most if hurst is not None else None
    return {name: regime.gap_gate(rows, most, long_only=one, hurst_most=bound) for name, one in (("two_sided", False), ("long_only", True))}


def compared(runs: dict[str, tuple[DataFrame, dict]], minutes: DataFrame, cooldown: int) -> DataFrame:
    """Metrics by configuration; ``runs``: name to its signals and the options of ``backtest.candidates``. One job for all."""
    needed = ("asset", "ts", "i", "signal", "sigma_hat", "z_score", "regime")
    found = {name: backtest.candidates(signals.select(*needed), minutes, **options) for name, (signals, options) in runs.items()}
    both = kept(reduce(DataFrame.unionByName, backtest.configurations(found)))
    by = ("config", "asset")
    return backtest.metrics(kept(backtest.accepted(both, cooldown, by)), by)
