"""Regime gates, transitions, signals and their gates."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.guards import floor_at
from tidemill.operators.order import blocked, carried, over, unblocked

#: Least forecast volatility that stops and targets are sized by.
SIGMA_FLOOR = 5e-4


def _moving_quantile(us: np.ndarray, values: np.ndarray, span: int, least: int, share: float) -> list[float | None]:
    """Quantile of the values (no NaN) of the last ``span`` microseconds, left-open, at each row in order of time."""
    held: list[float] = []
    out: list[float | None] = []
    first = last = 0
    known = ~np.isnan(values)
    for now in us.tolist():
        while last < len(us) and us[last] <= now:  # rows of equal time count for each other
            if known[last]:
                bisect.insort(held, float(values[last]))
            last += 1
        while us[first] <= now - span:
            if known[first]:
                del held[bisect.bisect_left(held, float(values[first]))]
            first += 1
        if len(held) < max(1, least):
            out.append(None)
            continue
        place = share * (len(held) - 1)
        low = int(place)
        a, b = held[low], held[min(low + 1, len(held) - 1)]
        out.append(a if a == b or place == low else a * (low + 1 - place) + b * (place - low))
    return out


def gate(bars: DataFrame, value: str = "sigma_hat", days: int = 60, least: int = 500, share: float = 0.5) -> DataFrame:
    """``regime_threshold`` (a quantile of the last ``days`` days, left-open) and ``regime``.

    The series is cut into blocks of ``days`` days; each block also gets the block before as halo, so a task holds two. A
    scan keeps the values of the frame in order: a window would sort the whole frame anew for each row.
    """
    span = days * 86_400
    own = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / span)
    rows = bars.withColumn("_block", F.explode(F.array(own, own + 1))).withColumn("_own", own == F.col("_block"))
    rows = rows.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    names = [*bars.columns, "regime_threshold"]

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("_us")
        found = _moving_quantile(group.column("_us").to_numpy(), group.column(value).to_numpy().astype(float), span * 1_000_000, least, share)
        return group.append_column("regime_threshold", pa.array(found, pa.float64())).filter(group.column("_own")).select(names)

    found = rows.groupBy("asset", "_block").applyInArrow(scan, T.StructType([*bars.schema, T.StructField("regime_threshold", T.DoubleType())]))
    return found.withColumn("regime", F.when(F.col(value) <= F.col("regime_threshold"), "ranging").otherwise("expansion"))


def transitions(bars: DataFrame, regime: str = "regime") -> DataFrame:
    """``previous`` regime and whether it changed; the first row has not."""
    rows = blocked(bars, back=1).withColumn("previous", F.lag(regime).over(over()))
    return unblocked(rows).withColumn("is_transition", F.coalesce(F.col("previous") != F.col(regime), F.lit(False)))


def since_transition(bars: DataFrame, source: str | None = None, dest: str | None = None) -> DataFrame:
    """``bars_since``: bars since the last change, or the last from ``source`` to ``dest``; NULL before the first."""
    wanted = F.col("is_transition")
    if source:
        wanted = wanted & (F.col("previous") == source)
    if dest:
        wanted = wanted & (F.col("regime") == dest)
    rows = carried(bars, F.when(wanted, F.col("i")), "_last")
    return rows.withColumn("bars_since", F.col("i") - F.col("_last")).drop("_last")


def signals(bars: DataFrame, z_threshold: float = 2.0, h: int = 24, k1: float = 1.0, k2: float = 1.0, tilt: bool = False) -> DataFrame:
    """Signal (+1, -1, 0), price distance, stop, target and time stop of each bar.

    Needs close, sigma_hat, regime, z_score and i; with ``tilt`` also beta1_sign and r1.
    """
    ranging = F.col("regime") == "ranging"
    long, short = ranging & (F.col("z_score") <= -z_threshold), ranging & (F.col("z_score") >= z_threshold)
    if tilt:
        lean = F.col("beta1_sign") * F.col("r1")
        long, short = long & (lean <= 0), short & (lean >= 0)
    signal = F.when(F.coalesce(long, F.lit(False)), 1).when(F.coalesce(short, F.lit(False)), -1).otherwise(0)
    rows = bars.withColumn("delta_p", floor_at(F.col("sigma_hat"), SIGMA_FLOOR) * F.col("close")).withColumn("signal", signal)
    side = F.when(F.col("signal") != 0, F.col("signal"))
    return rows.withColumns(
        {
            "stop_price": F.col("close") - side * k1 * F.col("delta_p"),
            "target_price": F.col("close") + side * k2 * F.col("delta_p"),
            "time_stop_bar": F.when(F.col("signal") != 0, F.col("i") + h).otherwise(F.lit(-1).cast("bigint")),
        }
    )


def gap_gate(bars: DataFrame, most: int = 48, long_only: bool = False, hurst_most: float | None = None) -> DataFrame:
    """Signals only within ``most`` bars after a transition, and below a Hurst exponent where one is given."""
    kept: Column = F.col("bars_since") <= most
    if hurst_most is not None:
        kept = kept & (F.col("hurst") <= hurst_most)
    if long_only:
        kept = kept & (F.col("signal") > 0)
    return bars.withColumn("signal", F.when(F.coalesce(kept, F.lit(False)), F.col("signal")).otherwise(0))


def likeliest(probabilities: DataFrame, columns: list[str]) -> DataFrame:
    """The regime column of greatest probability, the first of equal ones."""
    values, names = F.array(*columns), F.array(*[F.lit(c.removeprefix("regime_").removesuffix("_prob")) for c in columns])
    return probabilities.withColumn("regime", F.element_at(names, F.array_position(values, F.array_max(values)).cast("int")))
