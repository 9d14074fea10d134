"""Structured Streaming twins of the bar, session and event operators. The batch operators define their results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.events import Gaps, Scan


def bars(ticks: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of ticks, each given once the watermark has passed its end."""
    order = F.struct("ts", "event_id")
    found = ticks.withWatermark("ts", late).groupBy("asset", F.window("ts", width).alias("w"))
    found = found.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n_ticks"))
    return found.select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n_ticks")


def sessions(ticks: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of ticks without a gap, with their first and last time and count."""
    found = ticks.withWatermark("ts", late).groupBy("asset", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n_ticks"))
    return found.select("asset", "first", "last", "n_ticks")


EVENTS = "asset string, ts timestamp, price double, type string, theta_dynamic double"
_STATE = "anchor double, high double, high_at long, high_ts timestamp, low double, low_at long, low_ts timestamp, seen long, before double"


def directional_changes(bars_: DataFrame, theta: float = 0.002, gaps: Gaps = Gaps()) -> DataFrame:
    """Events of a stream of bars (asset, ts, close, theta_dynamic, is_gap); each micro-batch is taken in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan, seen = Scan(gaps, theta), 0
        if state.exists:
            anchor, high, high_at, high_ts, low, low_at, low_ts, seen, before = state.get
            scan.anchor = None if anchor is None or anchor != anchor else anchor
            scan.high, scan.low, scan.before = (high, high_at, high_ts, 0.5), (low, low_at, low_ts, 0.5), before
        out = []
        rows = pd.concat(list(batches)).sort_values("ts")
        for ts, close, limit, gap in zip(rows["ts"], rows["close"], rows["theta_dynamic"], rows["is_gap"], strict=True):
            found = scan.step(close, seen, ts, 0.5, limit, gap)
            seen += 1
            if found:
                out.append((key[0], *found[:4]))
        state.update((scan.anchor, *scan.high[:3], *scan.low[:3], seen, scan.before))
        yield pd.DataFrame(out, columns=["asset", "ts", "price", "type", "theta_dynamic"])

    return bars_.groupBy("asset").applyInPandasWithState(run, EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)
