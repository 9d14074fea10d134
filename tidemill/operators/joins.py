"""Ordered joins: as-of, folds over bars, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, value: str, by: str = "asset", ts: str = "ts", default: float | None = None, bucket: str = "day") -> DataFrame:
    """Each left row with the last ``value`` that is not NULL at or before its time.

    Both sides are merged inside buckets of time; the last value of the earlier buckets stands in at their start.
    """
    row = left.select(F.struct(*left.columns).alias("_row")).schema["_row"].dataType
    own = left.select(by, ts, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    both = own.union(right.select(by, ts, F.lit(0), F.lit(None).cast(row), F.col(value)))
    both = both.withColumn("_bucket", F.date_trunc(bucket, F.col(ts)))
    inside = Window.partitionBy(by, "_bucket").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    lasts = both.groupBy(by, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(ts))).alias("_last"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(by, "_bucket", F.last("_last", True).over(earlier).alias("_before"))
    found = both.withColumn("_now", F.last("_value", True).over(inside)).where("_side = 1").join(lasts, [by, "_bucket"])
    result: Column = F.coalesce("_now", "_before") if default is None else F.coalesce("_now", "_before", F.lit(default))
    return found.select("_row.*", result.alias(value))


def fold_table(bars: DataFrame, train: str, test: str, buffer_minutes: int) -> DataFrame:
    """Walk-forward folds of each series: train [start, train_end - buffer], test [train_end, train_end + test], one step a test."""
    ends = bars.groupBy("asset").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    step = F.expr(f"interval {test}")
    steps = F.explode(F.sequence(F.col("first") + F.expr(f"interval {train}"), F.col("last") - step, step)).alias("train_end")
    possible = ends.where(F.col("first") + F.expr(f"interval {train}") <= F.col("last") - step)
    folds = possible.select("asset", steps)
    return folds.select(
        "asset",
        (F.col("train_end") - F.expr(f"interval {train}")).alias("train_start"),
        (F.col("train_end") - F.expr(f"interval {buffer_minutes} minutes")).alias("train_cutoff"),
        F.col("train_end").alias("test_start"),
        (F.col("train_end") + step).alias("test_end"),
    )


def fold_rows(bars: DataFrame, folds: DataFrame, day: str = "day") -> DataFrame:
    """Bars of each fold, with ``part`` train or test; both ends count.

    Folds overlap, so the join is over ranges; every fold lists the days that it touches, and days are joined by hash.
    """
    days = F.explode(F.sequence(F.date_trunc(day, F.col("train_start")), F.date_trunc(day, F.col("test_end")), F.expr(f"interval 1 {day}"))).alias("_day")
    listed = folds.select("*", days).withColumnRenamed("asset", "_asset")
    rows = bars.withColumn("_day", F.date_trunc(day, F.col("ts")))
    joined = rows.join(listed, (F.col("asset") == F.col("_asset")) & (rows["_day"] == listed["_day"])).drop("_asset", "_day")
    part = F.array_compact(F.array(F.when(F.col("ts").between(F.col("train_start"), F.col("train_cutoff")), "train"), F.when(F.col("ts").between(F.col("test_start"), F.col("test_end")), "test")))
    return joined.withColumn("part", F.explode(part))


def admitted(folds: DataFrame, rows: DataFrame, least_train: int, least_test: int) -> DataFrame:
    """Folds with enough rows, numbered from 0 in time."""
    keys = ["asset", "train_start", "train_cutoff", "test_start", "test_end"]
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"))
    kept = sizes.where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test))
    return kept.withColumn("fold", F.row_number().over(Window.partitionBy("asset").orderBy("train_start")) - 1)


def split_dates(rows: DataFrame, train_start: str, train_end: str, oos_start: str) -> DataFrame:
    """Rows of the train span (both ends) and from the out-of-sample start on; a row may be in both, or in none."""
    ts = next(F.col(c) for c in ("end_timestamp", "start_timestamp", "timestamp", "ts") if c in rows.columns)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    part = F.array_compact(F.array(F.when(ts.between(at(train_start), at(train_end)), "train"), F.when(ts >= at(oos_start), "oos")))
    return rows.withColumn("part", F.explode(part))


def waits(strategies: DataFrame, model: str, transitions: DataFrame, default: int = 5) -> DataFrame:
    """The greatest wait of each transition of a model, the default where it has none."""
    own = strategies.where(F.col("Model") == model).groupBy(F.col("Transition").alias("transition")).agg(F.max("Wait").alias("_wait"))
    return transitions.join(own, "transition", "left").withColumn("wait", F.coalesce("_wait", F.lit(default))).drop("_wait")
