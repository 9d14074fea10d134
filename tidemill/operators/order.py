"""Order over distributed rows: running totals, dense positions, and windows over blocks with a halo.

A window over one long series would put all of it in one task.  Here a series is cut into buckets (of time) or blocks (of
positions), each of which is a partition of its own:

* ``running_total`` and ``indexed`` sum inside buckets and add what the earlier buckets hold, one row a bucket;
* ``blocked`` repeats the rows that a finite frame reaches over a block's border, so that windows over (series, block)
  give every row of the block its full frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 65_536


def running_total(df: DataFrame, value: Column, out: str, by: str = "asset", order: tuple[str, ...] = ("ts",), bucket: str = "day") -> DataFrame:
    """Sum of ``value`` over all rows of the series up to and with this one."""
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.col(order[0]))).withColumn("_value", value)
    inside = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(by, "_bucket").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    total = F.sum("_value").over(inside)
    return rows.withColumn(out, total).join(sums, [by, "_bucket"]).withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before", "_value")


def running_max(df: DataFrame, value: Column, out: str, by: str = "asset", order: tuple[str, ...] = ("ts",), bucket: str = "day") -> DataFrame:
    """Greatest ``value`` over all rows of the series up to and with this one."""
    rows = df.withColumn("_bucket", F.date_trunc(bucket, F.col(order[0]))).withColumn("_value", value)
    inside = Window.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy(by, "_bucket").agg(F.max("_value").alias("_most")).select(by, "_bucket", F.max("_most").over(earlier).alias("_before"))
    return rows.withColumn(out, F.max("_value").over(inside)).join(most, [by, "_bucket"]).withColumn(out, F.greatest(out, "_before")).drop("_bucket", "_before", "_value")


def indexed(df: DataFrame, by: str = "asset", order: tuple[str, ...] = ("ts",), out: str = "i", bucket: str = "day") -> DataFrame:
    """Dense position of each row in its series, from 0."""
    return running_total(df, F.lit(1).cast("bigint"), out, by, order, bucket).withColumn(out, F.col(out) - 1)


def blocked(df: DataFrame, back: int = 0, ahead: int = 0, i: str = "i", block: int = BLOCK) -> DataFrame:
    """Rows with the block they count in (``_block``), those near a border also as halo of the next one.

    Frames may reach ``back`` rows before and ``ahead`` rows after a row; ``unblocked`` drops the halo again.
    """
    back, ahead = min(back, block), min(ahead, block)
    own = F.floor(F.col(i) / block)
    place = F.col(i) % block
    blocks = F.array_compact(F.array(own, F.when(place >= block - back, own + 1), F.when((place < ahead) & (own > 0), own - 1)))
    return df.withColumn("_block", F.explode(blocks)).withColumn("_own", F.floor(F.col(i) / block) == F.col("_block"))


def unblocked(df: DataFrame) -> DataFrame:
    """Each row once, without the columns of ``blocked``."""
    return df.where("_own").drop("_block", "_own")


def over(by: str = "asset", i: str = "i") -> Window:
    """Order inside the blocks of a series."""
    return Window.partitionBy(by, "_block").orderBy(i)


def carried(df: DataFrame, value: Column, out: str, by: str = "asset", i: str = "i", block: int = BLOCK) -> DataFrame:
    """The last ``value`` that is not NULL up to each row: inside its block, else from the blocks before."""
    rows = df.withColumn("_block", F.floor(F.col(i) / block)).withColumn("_value", value)
    inside = Window.partitionBy(by, "_block").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lasts = rows.groupBy(by, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(i))).alias("_last"))
    lasts = lasts.select(by, "_block", F.last("_last", True).over(earlier).alias("_before"))
    found = rows.withColumn(out, F.last("_value", True).over(inside)).join(lasts, [by, "_block"])
    return found.withColumn(out, F.coalesce(F.col(out), F.col("_before"))).drop("_block", "_value", "_before")
