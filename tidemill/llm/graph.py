"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.cut import cut, drop


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (hi, lo) with hi > lo; each node's larger neighbours, then its smaller ones, move to its least."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    least = large.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
    return moved.select("e.hi", "e.lo").where("hi > lo").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node that it reaches) for every node that is no root itself.

    ``edges`` may repeat, run in either direction and hold loops; rows with a null end are left out.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    before = state(now)
    while True:
        then = cut(_stars(now))
        after = state(then)
        drop(now)
        now = then
        if after == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = after
