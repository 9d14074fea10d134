"""Order statistics of everything up to each row, by blocks of positions.

The median at a row is the middle of all values before it, so no frame bounds what it depends on.  But inside a block of m
rows it can move by m / 2 places at most from where it stood at the block's start.  So a block needs only the earlier values
around its starting median, and how many lie below these.  Which ones they are follows from counts: values are cut into
ranges by a sort over all tasks, and the rows of each (block, range) are counted, a table whose size is bounded whatever the
series' length.  Then every block is a task of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.order import BLOCK
from tidemill.scratch import kept

#: Blocks of a series at most: beyond, blocks grow, so that counts by (block, range) stay below MOST * MOST.
MOST = 4_096
#: Tasks that share the earlier values of one range.
SHARES = 16


def _reach(size: int) -> int:
    """Places that a median can move while ``size`` values come, with room for one that is on its way."""
    return size // 2 + 2


def _needed(counts: DataFrame) -> DataFrame:
    """``asset, block, range, below, before`` of the ranges that hold each block's starting median and what it can reach.

    ``counts``: asset, block, range, n, with a row of range -1 for each block that has the block's own number of values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asset, so_far = None, {}
        for batch in batches:
            out: list[tuple] = []
            for of, block, part, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != asset:
                    asset, so_far = of, {}
                if part >= 0:
                    so_far[part] = so_far.get(part, 0) + n
                elif so_far:
                    parts = np.array(sorted(so_far))
                    sizes = np.array([so_far[p] for p in parts.tolist()])
                    ends = sizes.cumsum()
                    before = int(ends[-1])
                    low, high = max(0, (before + 1) // 2 - _reach(n)), min(before, (before + 1) // 2 + _reach(n))
                    first, last = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left")
                    out += [(of, block, int(parts[k]), int(ends[first] - sizes[first]), before) for k in range(min(first, last), last + 1)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["asset", "block", "range", "below", "before"])

    order = ("asset", "block", "range")
    return counts.repartition("asset").sortWithinPartitions(*order).select(*order, "n").mapInArrow(run, "asset string, block long, range long, below long, before long")


def _halves(values: np.ndarray, sizes: np.ndarray, low: int, reach: int) -> tuple[list[float], list[float]]:
    """The ``reach`` values on either side of the place ``low`` among sorted values that each count ``sizes`` times."""
    ends = sizes.cumsum()
    under = np.clip(low - (ends - sizes), 0, sizes)
    over = sizes - under
    near = under[::-1]
    near = np.clip(reach - (near.cumsum() - near), 0, near)[::-1]
    over = np.clip(reach - (over.cumsum() - over), 0, over)
    return np.repeat(values, near).tolist(), np.repeat(values, over).tolist()


def _medians(rows: pa.Table, earlier: pa.Table, out: str) -> pa.Table:
    """Medians of one block: two heaps around the place where the earlier values leave off."""
    rows = rows.sort_by("i")
    own = rows.column("x").to_pylist()
    low: list[float] = []  # the lower half, negated
    high: list[float] = []
    n_low = n_high = 0
    if earlier.num_rows:
        earlier = earlier.sort_by("x")
        before, below = earlier.column("before")[0].as_py(), earlier.column("below")[0].as_py()
        n_low, n_high = (before + 1) // 2, before // 2
        left, high = _halves(earlier.column("x").to_numpy(), earlier.column("n").to_numpy(), n_low - below, _reach(len(own)))
        low = [-x for x in left]
        heapq.heapify(low)
        heapq.heapify(high)
    found: list[float | None] = []
    for x in own:
        if x is not None:
            heapq.heappush(low, -heapq.heappushpop(high, x))
            n_low += 1
            if n_low > n_high + 1:
                heapq.heappush(high, -heapq.heappop(low))
                n_low, n_high = n_low - 1, n_high + 1
        found.append(None if not n_low else -low[0] if n_low > n_high else -low[0] + (high[0] + low[0]) * 0.5)
    return pa.table([rows.column("asset"), rows.column("i"), pa.array(found, pa.float64())], ["asset", "i", out])


def expanding_median(bars: DataFrame, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Median of all values up to each row, NULLs and NaNs left out; rows need their place ``i`` in the series."""
    x = F.col(value).cast("double")
    rows = kept(bars.select("asset", "i", F.when(~F.isnan(x), x).alias("x")))
    last, total = rows.agg(F.max("i"), F.count("x")).first()
    size = max(block, -(-((last or 0) + 1) // MOST))
    rows = rows.withColumn("block", F.floor(F.col("i") / size))
    valued = rows.where(F.col("x").isNotNull()).repartitionByRange(max(1, -(-total // size)), "asset", "x")
    valued = kept(valued.withColumn("range", F.spark_partition_id().cast("long")))
    counts = valued.groupBy("asset", "block", "range").agg(F.count("*").alias("n")).select("asset", "block", "range", "n")
    needed = kept(_needed(counts.union(rows.groupBy("asset", "block").agg(F.count("x").alias("n")).select("asset", "block", F.lit(-1).cast("long"), "n"))))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")
    same = valued.join(needed.select("asset", "range").distinct(), ["asset", "range"], "left_semi").groupBy("asset", "range", "block", "x").agg(F.count("*").alias("n"))
    same = same.select("asset", "range", F.col("block").alias("_of"), "x", "n", spread)
    wanted = needed.withColumn("share", (F.col("block") % SHARES).cast("int"))
    earlier = wanted.join(same, ["asset", "range", "share"]).where("_of < block").groupBy("asset", "block", "x", "below", "before").agg(F.sum("n").alias("n"))
    earlier = earlier.select(F.col("asset").alias("_asset"), F.col("block").alias("_block"), "x", "n", "below", "before")
    found = rows.groupBy("asset", "block").cogroup(earlier.groupBy("_asset", "_block")).applyInArrow(lambda a, b: _medians(a, b, out), f"asset string, i long, {out} double")
    return bars.join(found, ["asset", "i"])
