"""Bars: resampling, gaps, returns, range variance and quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.guards import ln, ratio
from tidemill.operators.order import blocked, indexed, over, unblocked

#: 2 ln 2 - 1.
GK = 0.3862943611198906


def resample(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Open, high, low, close of each left-closed time bucket that has ticks, labelled by its start."""
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    return (
        ticks.groupBy("asset", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", first).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", last).alias("close"), F.count("*").alias("n_ticks"))
        .select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n_ticks")
    )


def resample_bars(bars: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Wider bars from narrower ones."""
    return (
        bars.groupBy("asset", F.window("ts", width).alias("w"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"))
        .select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close")
    )


def gk_variance() -> Column:
    """Garman-Klass variance of a bar, never negative."""
    spread, move = ln(F.col("high") / F.col("low")), ln(F.col("close") / F.col("open"))
    return F.greatest(F.lit(0.0), 0.5 * spread * spread - GK * move * move)


def enriched(bars: DataFrame, minutes: int = 5) -> DataFrame:
    """Bars with position, gap flag and minutes, returns (inside the bar after a gap), and range variance."""
    rows = blocked(indexed(bars), back=1)
    before = F.lag("ts").over(over())
    since = F.timestamp_diff("MICROSECOND", before, F.col("ts"))
    rows = rows.select(
        "*",
        (since.isNull() | (since > minutes * 60_000_000)).alias("is_gap"),
        F.coalesce(since / 60e6, F.lit(0.0)).alias("gap_minutes"),
        ln(F.col("close") / F.lag("close").over(over())).alias("return_c2c_raw"),
    )
    rows = unblocked(rows).withColumn("return", F.when(F.col("is_gap"), ln(F.col("close") / F.col("open"))).otherwise(F.col("return_c2c_raw")))
    return rows.withColumn("gk_var", gk_variance()).withColumn("gk_bar", F.sqrt("gk_var"))


def validate(bars: DataFrame) -> DataFrame:
    """One row of counts of what is wrong with bars, over all rows."""
    prices = ("open", "high", "low", "close")
    wrong = {
        "n_rows": F.count("*"),
        "n_null": F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in (*prices, "ts")]) == 1),
        "n_high_low": F.count_if(F.col("high") < F.col("low")),
        "n_high_body": F.count_if(F.col("high") < F.greatest("open", "close")),
        "n_low_body": F.count_if(F.col("low") > F.least("open", "close")),
        "n_not_positive": F.count_if(F.least(*prices) <= 0),
    }
    return bars.agg(*[v.alias(k) for k, v in wrong.items()])


def distinct_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in order, chosen before the shuffle where partitions hold several."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def typical_spread(bars: DataFrame) -> DataFrame:
    """Summary of bars: count, gaps, return and variance moments."""
    return bars.agg(
        F.count("*").alias("n_bars"), F.count_if("is_gap").alias("n_gaps"), ratio(F.count_if("is_gap").cast("double"), F.count("*").cast("double")).alias("gap_share"),
        F.max(F.abs("return_c2c_raw")).alias("max_raw"), F.max(F.abs("return")).alias("max_clean"), (F.avg("gk_var") * 1e6).alias("gk_mean"), (F.stddev_samp("gk_var") * 1e6).alias("gk_std"),
    )
