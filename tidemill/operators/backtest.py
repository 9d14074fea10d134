"""Execution of signals over minute bars: candidates in parallel, then acceptance in time order, then metrics.

An exit depends on its signal, the minutes after it and the spreads, never on other trades. So all exits are found at
once by joins and aggregates (``candidates``).  Which candidates become trades (``accepted``) is a path over short rows, one
a signal: it is followed in blocks, all at once, and joined by doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.guards import ratio
from tidemill.operators.joins import as_of
from tidemill.operators.order import BLOCK, blocked, indexed, running_max, running_total
from tidemill.operators.regime import SIGMA_FLOOR
from tidemill.scratch import kept

DEFAULT_SPREAD = 1.5e-5


def candidates(
    features: DataFrame, minutes: DataFrame, spreads: DataFrame | None = None, flat: float = 0.2, h: int = 24, k1: float = 1.0, k2: float = 1.0, z_exit: float | None = None, offset: int = 5
) -> DataFrame:
    """Every signal whose entry minute exists, with its entry, stop, target and exit.

    ``features``: asset, ts, i, signal, sigma_hat, z_score, regime; ``minutes``: asset, ts, open, high, low, close and, if known, place ``m``.
    ``spreads`` (asset, ts, spread as a share) replaces the flat cost. An exit is the first of at most 5 h + 10 minutes
    after the entry that touches the stop, else the target, else is late, else reverts; else the last of these minutes.
    """
    c = F.col
    most = 5 * h + 10
    bars = minutes.select("asset", "ts", "open", "high", "low", "close", "m") if "m" in minutes.columns else indexed(minutes.select("asset", "ts", "open", "high", "low", "close"), out="m")
    z = features.select("asset", "ts", c("z_score").alias("z"))
    bars = bars.join(z, ["asset", "ts"], "left")
    sig = features.where("signal != 0").select("asset", c("ts").alias("signal_time"), (c("ts") + F.expr(f"interval {offset} minutes")).alias("entry_time"), c("i").alias("bar"), "signal", "sigma_hat", c("z_score").alias("z_score_entry"), "regime")
    if spreads is not None:
        own = spreads.select("asset", c("ts").alias("signal_time"), c("spread").alias("_share"))
        sig = sig.join(own, ["asset", "signal_time"], "left").withColumn("_share", F.coalesce("_share", F.lit(DEFAULT_SPREAD)))
        bars = as_of(bars, spreads, "spread", default=DEFAULT_SPREAD).withColumn("exit_spread", c("spread") * c("close")).drop("spread")
    else:
        sig = sig.withColumn("_share", F.lit(None).cast("double"))
        bars = bars.withColumn("exit_spread", F.lit(float(flat)))
    entry = bars.select("asset", c("ts").alias("entry_time"), c("m").alias("entry_m"), c("open").alias("_open"))
    sig = sig.join(entry, ["asset", "entry_time"]).withColumn("spread_usd", F.coalesce(c("_share") * c("_open"), F.lit(float(flat))))
    sig = sig.withColumn("entry_price", c("_open") + c("signal") * 0.5 * c("spread_usd")).withColumn("sigma_hat", F.greatest(c("sigma_hat"), F.lit(SIGMA_FLOOR)))
    wide = c("sigma_hat") * c("entry_price")
    sig = sig.withColumn("_delta", F.when(k1 * wide < 2 * c("spread_usd"), 2 * c("spread_usd") / max(k1, 1e-6)).otherwise(wide))
    sig = sig.withColumns({"stop_price": c("entry_price") - c("signal") * k1 * c("_delta"), "target_price": c("entry_price") + c("signal") * k2 * c("_delta")})
    sig = sig.withColumn("_late", c("signal_time") + F.expr(f"interval {5 * h} minutes")).drop("_open", "_share", "_delta")
    # Minutes fall into bins as wide as the bound: an equi-join on two bins holds every minute in reach.
    binned = bars.withColumn("_bin", F.floor(c("m") / most)).select("asset", "_bin", "m", c("ts").alias("t"), "high", "low", "close", "z", "exit_spread")
    reach = sig.withColumn("_bin", F.explode(F.array(F.floor((c("entry_m") + 1) / most), F.floor((c("entry_m") + 1) / most) + 1)))
    near = reach.join(binned, ["asset", "_bin"]).where((c("m") > c("entry_m")) & (c("m") <= c("entry_m") + most))
    long = c("signal") == 1
    stop = F.when(long, c("low") <= c("stop_price")).otherwise(c("high") >= c("stop_price"))
    target = F.when(long, c("high") >= c("target_price")).otherwise(c("low") <= c("target_price"))
    revert = F.coalesce(c("z") * c("signal") >= z_exit, F.lit(False)) if z_exit is not None else F.lit(False)
    reason = F.when(stop, "stop_loss").when(target, "take_profit").when(c("t") >= c("_late"), "time_stop").when(revert, "z_revert")
    near = near.withColumn("_reason", reason)
    at = F.struct("t", "close", "exit_spread", "_reason")
    keys = ["asset", "signal_time", "entry_time", "bar", "signal", "sigma_hat", "z_score_entry", "regime", "entry_price", "stop_price", "target_price", "spread_usd"]
    ends = near.groupBy(*keys).agg(F.min_by(at, F.when(c("_reason").isNotNull(), c("m"))).alias("_exit"), F.max_by(at, "m").alias("_end"))
    # A signal on the last minute has nothing after it: it leaves at its own entry minute.
    alone = sig.join(ends.select("asset", "signal_time"), ["asset", "signal_time"], "left_anti")
    own = bars.select("asset", c("ts").alias("entry_time"), F.struct(c("ts").alias("t"), "close", "exit_spread", F.lit(None).cast("string").alias("_reason")).alias("_end"))
    ends = ends.unionByName(alone.join(own, ["asset", "entry_time"]).select(*keys, F.lit(None).cast(ends.schema["_exit"].dataType).alias("_exit"), "_end"))
    ends = ends.withColumn("_exit", F.coalesce("_exit", "_end")).withColumn("exit_reason", F.coalesce(c("_exit._reason"), F.lit("end_of_data")))
    level = F.when(c("exit_reason") == "stop_loss", c("stop_price")).when(c("exit_reason") == "take_profit", c("target_price")).otherwise(c("_exit.close"))
    ends = ends.withColumn("exit_time", c("_exit.t")).withColumn("exit_price", level - c("signal") * 0.5 * c("_exit.exit_spread"))
    ends = ends.withColumn("spread_usd", F.when(c("exit_reason") == "end_of_data", c("_exit.exit_spread")).otherwise(c("spread_usd")))
    pnl = c("signal") * (c("exit_price") - c("entry_price"))
    ends = ends.withColumn("side", F.when(c("signal") == 1, "LONG").otherwise("SHORT")).withColumn("pnl_usd", pnl).withColumn("return_pct", c("pnl_usd") / c("entry_price"))
    return ends.withColumn("duration_min", F.timestamp_diff("SECOND", c("entry_time"), c("exit_time")) / 60.0).drop("_exit", "_end", "signal")


_STEP = "_key string, _block long, seq long, signal_time timestamp_ntz, next long, out long"


def _successors(group: pa.Table, cooldown: int, block: int) -> pa.Table:
    """The next candidate behind each one that is taken (``next``), and the first of these beyond the block (``out``)."""
    group = group.sort_by("seq")
    seq, start = group.column("seq").to_numpy(), group.column("start").to_numpy()
    bar, own = group.column("bar").to_numpy(), group.column("_own").to_numpy(zero_copy_only=False)
    ahead = np.maximum(start, seq[0] + np.searchsorted(bar, bar + cooldown))
    ahead = np.maximum(ahead, seq + 1)
    first, end = int(seq[0]), (int(seq[0]) // block + 1) * block
    out = ahead.tolist()
    for k in range(int(own.sum()) - 1, -1, -1):
        if out[k] < end and out[k] - first < len(out):
            out[k] = out[out[k] - first]
    columns = [group.column("_key"), group.column("_block"), group.column("seq"), group.column("signal_time"), pa.array(ahead), pa.array(out, pa.int64())]
    return pa.table(columns, [f.split()[0] for f in _STEP.split(", ")]).filter(group.column("_own"))


def _taken(group: pa.Table) -> pa.Table:
    """The candidates of one block that follow each other from its entry on."""
    group = group.sort_by("seq")
    seq, ahead = group.column("seq").to_pylist(), group.column("next").to_pylist()
    at, kept_rows = group.column("entry")[0].as_py() - seq[0], []
    while at < len(seq):
        kept_rows.append(at)
        at = ahead[at] - seq[0]
    return group.take(pa.array(kept_rows, pa.int64())).select(["_key", "signal_time"])


def accepted(found: DataFrame, cooldown: int = 24, by: tuple[str, ...] = ("asset",), block: int = BLOCK) -> DataFrame:
    """The candidates that become trades: none while another is open, nor within ``cooldown`` bars of the last entry.

    Which candidate follows one that is taken depends on that one alone, so the trades are the path from the first candidate
    on.  Blocks of candidates find their successors and, from the last row back, where a path through them leaves the block.
    The blocks' entries are then reached by doubling the leaps from block to block, as many rounds as the number of blocks has
    digits in base two, and each block follows its own part of the path.
    """
    c = F.col
    block = max(block, cooldown)
    key = F.concat_ws("|", *by)
    ready = F.least(c("signal_time"), c("entry_time") - F.expr("interval 1 microsecond"))
    rows = found.select(key.alias("_key"), "signal_time", ready.alias("ready"), (c("exit_time") - F.expr("interval 1 microsecond")).alias("ts"), "bar")
    rows = kept(indexed(rows, "_key", ("signal_time",), "seq"))
    blocks = (rows.agg(F.max("seq")).first()[0] or 0) // block + 1
    # A candidate can be next if it is ready once this one has left: it comes behind the last that was ready too early.
    early = as_of(rows.drop("ready"), rows.select("_key", c("ready").alias("ts"), c("seq").alias("last")), "last", by="_key", default=-1)
    near = blocked(early.withColumn("start", c("last").cast("long") + 1), ahead=max(cooldown, 1), i="seq", block=block)
    near = near.select("_key", "_block", "seq", "signal_time", "bar", "start", "_own")
    steps = kept(near.groupBy("_key", "_block").applyInArrow(lambda group: _successors(group, cooldown, block), _STEP))
    entries = rows.where("seq = 0").select("_key", "seq")
    leaps = steps.select("_key", "seq", "out")
    for _ in range((blocks - 1).bit_length()):
        entries = kept(entries.union(entries.join(leaps, ["_key", "seq"]).select("_key", c("out").alias("seq"))).distinct())
        leaps = kept(leaps.join(leaps.select("_key", c("seq").alias("out"), c("out").alias("_then")), ["_key", "out"]).select("_key", "seq", c("_then").alias("out")))
    own = entries.select("_key", F.floor(c("seq") / block).alias("_block"), c("seq").alias("entry"))
    path = steps.join(own, ["_key", "_block"]).groupBy("_key", "_block").applyInArrow(_taken, "_key string, signal_time timestamp_ntz")
    return found.withColumn("_key", key).join(path, ["_key", "signal_time"], "left_semi").drop("_key")


def daily(trades: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Profit of each day on which trades left."""
    return trades.groupBy(*by, F.to_date("exit_time").alias("exit_date")).agg(F.sum("pnl_usd").alias("pnl_usd"), F.count("*").alias("n_trades"))


def drawdown(trades: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Cumulative profit of each trade in order, the greatest so far, and the distance from it."""
    rows = running_total(trades.withColumn("_key", F.concat_ws("|", *by)), F.col("pnl_usd"), "cum_pnl", "_key", ("signal_time",))
    rows = running_max(rows, F.col("cum_pnl"), "peak", "_key", ("signal_time",))
    return rows.withColumn("drawdown", F.col("cum_pnl") - F.col("peak")).select(*by, "signal_time", "cum_pnl", "peak", "drawdown")


def exit_reasons(trades: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Trades by exit reason."""
    return trades.groupBy(*by, "exit_reason").agg(F.count("*").alias("n_trades"))


def metrics(trades: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """One row of metrics for each configuration: count, win rate, profit, profit factor, drawdown, Sharpe, duration, spread."""
    keys = list(by)
    pnl = F.col("pnl_usd")
    own = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"), F.avg((pnl > 0).cast("double")).alias("win_rate"), F.sum(pnl).alias("total_pnl_usd"),
        ratio(F.sum(F.when(pnl > 0, pnl)), F.abs(F.sum(F.when(pnl <= 0, pnl)))).alias("profit_factor"), F.avg("duration_min").alias("mean_duration_min"), F.avg("spread_usd").alias("avg_spread_usd"),
    )
    worst = drawdown(trades, by).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown_usd"))
    sharpe = F.coalesce(ratio(F.avg("pnl_usd"), F.stddev_samp("pnl_usd")) * (252.0**0.5), F.lit(0.0))
    return own.join(worst, keys).join(daily(trades, by).groupBy(*keys).agg(sharpe.alias("daily_sharpe")), keys)


def reasons_map(trades: DataFrame, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Exit reasons of each configuration as one map."""
    return exit_reasons(trades, by).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("exit_reason", "n_trades")))).alias("exit_reasons"))


def configurations(named: dict[str, DataFrame]) -> Iterator[DataFrame]:
    """Frames of trades or candidates with their configuration's name, to be run side by side."""
    return (df.withColumn("config", F.lit(name)) for name, df in named.items())
