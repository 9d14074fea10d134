"""Directional-change events under a moving threshold: a scan with constant state over each series and scale.

The series is scanned in blocks of bars, all at once, from guessed states that are then corrected. The same state serves the
streaming twin (``streaming.live``).
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.operators.order import BLOCK
from tidemill.operators.rolling import fractal_metrics
from tidemill.scratch import kept

@dataclass(frozen=True)
class Scale:
    """One sensitivity: threshold base, window, aggression."""

    name: str
    theta: float = 0.002
    window: int = 30
    aggression: float = 2.0

    @staticmethod
    def of(name: str, config: dict) -> Scale:
        """A scale by a configuration's own names and defaults (which differ from the constructor's)."""
        return Scale(name, config.get("theta_base", 0.005), config.get("window", 50), config.get("lambda_aggression", 2.0))


@dataclass(frozen=True)
class Gaps:
    """What a gap bar does: ``reset`` starts anew, ``bridge`` widens the threshold unless it jumps too far, ``exclude`` nothing."""

    mode: str = "exclude"
    widened: float = 1.5
    most: float = 0.10


@dataclass
class Scan:
    """State between bars: the last event's price once there was one, before that the extremes since the start."""

    gaps: Gaps
    theta: float
    anchor: float | None = None
    high: tuple | None = None
    low: tuple | None = None
    before: float | None = None

    def start(self, bar: tuple) -> None:
        """Begin at a bar (price, position, ts, hurst)."""
        self.anchor, self.high, self.low = None, bar, bar

    def step(self, price: float, place: int, ts, hurst: float, theta: float | None, gap: bool) -> tuple | None:
        """Take one bar; an event (ts, price, type, threshold, hurst) if it makes one."""
        bar, before, self.before = (price, place, ts, hurst), self.before, price
        if self.high is None:
            self.start(bar)
            return None
        limit = theta if theta and theta > 0 else self.theta
        if gap:
            leap = abs(price - before) / before if before and before > 0 else 0.0
            if self.gaps.mode == "reset" or self.gaps.mode == "bridge" and leap > self.gaps.most:
                self.start(bar)
                return None
            limit *= self.gaps.widened if self.gaps.mode == "bridge" else 1.0
        if self.anchor is not None:
            kind = "upturn" if price >= self.anchor * (1 + limit) else "downturn" if price <= self.anchor * (1 - limit) else None
            if kind:
                self.anchor = price
                return ts, price, kind, limit, hurst
            return None
        self.high, self.low = max(self.high, bar, key=lambda x: x[0]), min(self.low, bar, key=lambda x: x[0])
        if self.low[0] <= 0 or (self.high[0] - self.low[0]) / self.low[0] < limit:
            return None
        kind, found = ("upturn", self.high) if self.high[1] > self.low[1] else ("downturn", self.low)
        self.anchor = found[0]
        return found[2], found[0], kind, limit, found[3]


def metrics(bars: DataFrame, scales: list[Scale], ref: int = 288, gap_minutes: float = 120.0) -> DataFrame:
    """The rolling metrics of every scale, one below the other."""
    out = None
    for s in scales:
        own = fractal_metrics(bars, s.theta, s.window, ref, s.aggression, gap_minutes).withColumns({"scale": F.lit(s.name), "base": F.lit(s.theta), "first": F.lit(s.window + ref)})
        out = own if out is None else out.unionByName(own)
    return out


def causal_features(bars: DataFrame, scale: Scale = Scale("features"), ref: int = 288, gap_minutes: float = 120.0) -> DataFrame:
    """Features of each bar that know nothing of it or of later ones: Hurst exponent, energy, penalty, threshold, volatility."""
    own = fractal_metrics(bars, scale.theta, scale.window, ref, scale.aggression, gap_minutes)
    return own.select("asset", "ts", "hurst", "energy_v", "fractal_f", "theta_dynamic", F.col("sigma_t").alias("sigma_local"))


_BAR = "struct<price: double, place: bigint, ts: timestamp_ntz, hurst: double>"
_STATE = f"struct<anchor: double, high: {_BAR}, low: {_BAR}, before: double>"
_EVENT = "struct<ts: timestamp_ntz, price: double, type: string, theta_dynamic: double, hurst_snapshot: double, is_gap_event: boolean>"
_BLOCKS = f"asset string, scale string, _block long, entry {_STATE}, exit {_STATE}, events array<{_EVENT}>"


def _block_scanned(rows: pa.Table, entry: pa.Table, gaps: Gaps, schema: pa.Schema) -> pa.Table:
    """One block of bars from one state: its events and the state behind it."""
    rows, state = rows.sort_by("i"), entry.column("entry")[0].as_py()
    scan = Scan(gaps, rows.column("base")[0].as_py())
    if state is not None:
        scan.anchor, scan.before = state["anchor"], state["before"]
        scan.high, scan.low = (tuple(x.values()) if x else (scan.anchor, 0, None, 0.0) for x in (state["high"], state["low"]))
    found = []
    for i, ts, close, theta, hurst, gap in zip(*(rows.column(c).to_pylist() for c in ("i", "ts", "close", "theta_dynamic", "hurst", "sampler_gap")), strict=True):
        if event := scan.step(close, i, ts, hurst, theta, gap):
            found.append({"ts": event[0], "price": event[1], "type": event[2], "theta_dynamic": event[3], "hurst_snapshot": event[4], "is_gap_event": gap})
    ends = (None, None) if scan.anchor is not None else (scan.high, scan.low)  # past the first event, extremes don't count
    high, low = (dict(zip(("price", "place", "ts", "hurst"), x, strict=True)) if x else None for x in ends)
    out = {c: rows.column(c)[0].as_py() for c in ("asset", "scale", "_block")}
    return pa.Table.from_pylist([{**out, "entry": state, "exit": {"anchor": scan.anchor, "high": high, "low": low, "before": scan.before}, "events": found}], schema)


def directional_changes(bars: DataFrame, scales: list[Scale], gaps: Gaps = Gaps(), ref: int = 288, gap_minutes: float = 120.0, block: int = BLOCK) -> DataFrame:
    """Events of every scale: time, price, direction, threshold, Hurst exponent, and whether a gap bar made it.

    All blocks of a series are scanned at once, each as if the series began there.  Where the state behind the block before
    turns out to be another one, the block is scanned again from it, until all entries agree.  Two scans of the same bars are
    at one from the first event that both find, so that the second round mostly is the last; a block without any event hands
    its entry on, one block a round.
    """
    keys = ["asset", "scale", "_block"]
    rows = metrics(bars, scales, ref, gap_minutes).where("i >= first").select("asset", "scale", F.floor(F.col("i") / block).alias("_block"), "i", "ts", "close", "theta_dynamic", "hurst", "sampler_gap", "base")
    rows = kept(rows)
    schema = to_arrow_schema(T._parse_datatype_string(_BLOCKS))

    def scanned(entries: DataFrame) -> DataFrame:
        own = entries.select(*(F.col(k).alias(f"{k}_") for k in keys), "entry")
        return kept(rows.join(entries.select(*keys), keys, "left_semi").groupBy(*keys).cogroup(own.groupBy(*(f"{k}_" for k in keys))).applyInArrow(lambda a, b: _block_scanned(a, b, gaps, schema), _BLOCKS))

    done = scanned(rows.select(*keys).distinct().withColumn("entry", F.lit(None).cast(_STATE)))
    before = Window.partitionBy("asset", "scale").orderBy("_block")
    while True:
        wanted = done.select(*keys, "entry", F.lag("exit").over(before).alias("_wanted")).where(~F.col("entry").eqNullSafe(F.col("_wanted")))
        wanted = kept(wanted.select(*keys, F.col("_wanted").alias("entry")))
        if wanted.isEmpty():
            break
        done = kept(done.join(wanted, keys, "left_anti").unionByName(scanned(wanted)))
    return done.select("asset", "scale", F.explode("events").alias("e")).select("asset", "scale", "e.*")


def counts(events: DataFrame) -> DataFrame:
    """Events by scale and direction, and those made by gaps."""
    return events.groupBy("scale", "type").agg(F.count("*").alias("n_events"), F.count_if("is_gap_event").alias("n_gap_events"))
