"""Effective spreads from open, high, low and close by rolling moments of discrete returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.guards import clipped, ratio
from tidemill.operators.order import blocked, over, unblocked
from tidemill.operators.rolling import frame
from tidemill.operators.running import expanding_median


def edge(bars: DataFrame, window: int = 288) -> DataFrame:
    """``spread`` (a share of the price) over the last ``window`` bars, that is window - 1 steps; NULL where undefined."""
    c = F.col
    rows = blocked(bars, window + 1)
    w = over()
    logs = {k: F.log(k[1:]) for k in ("_open", "_high", "_low", "_close")}
    rows = rows.withColumns(logs).withColumn("_mid", (c("_high") + c("_low")) / 2)
    before = {f"{k}1": F.lag(k).over(w) for k in ("_high", "_low", "_close", "_mid")}
    rows = rows.withColumns(before)
    moved = F.when((c("_high") != c("_low")) | (c("_low") != c("_close1")), 1.0).otherwise(0.0)
    is_ = lambda a, b: F.when(c(a) != c(b), 1.0).otherwise(0.0)
    rows = rows.withColumns(
        {
            "_t": F.when(c("_close1").isNotNull(), moved),
            "_r1": c("_mid") - c("_open"),
            "_r2": c("_open") - c("_mid1"),
            "_r3": c("_mid") - c("_close1"),
            "_r4": c("_close1") - c("_mid1"),
            "_r5": c("_open") - c("_close1"),
        }
    ).withColumns({f"_r{k}": F.when(c("_t").isNotNull(), c(f"_r{k}")) for k in (1, 2)})
    near = frame(2 - window, 0)
    mean = lambda x: F.avg(x).over(near)
    rows = rows.withColumns(
        {
            "_n": F.count("_t").over(near), "_pt": mean(c("_t")),
            "_po": mean(c("_t") * is_("_open", "_high")) + mean(c("_t") * is_("_open", "_low")),
            "_pc": mean(c("_t") * is_("_close1", "_high1")) + mean(c("_t") * is_("_close1", "_low1")),
            **{f"_m{k}": mean(c(f"_r{k}")) for k in (1, 3, 5)},
        }
    )
    # d_k = r_k - (m_k / pt) t, with m and pt of the frame: products expand into means that do not depend on the row.
    a = {k: ratio(c(f"_m{k}"), c("_pt")) for k in (1, 3, 5)}
    p, q = ratio(F.lit(-4.0), c("_po")), ratio(F.lit(-4.0), c("_pc"))
    names = {1: "_r2", 2: "_r5"}
    r4 = c("_r4")

    def moments(first: str, k: int) -> tuple[Column, Column]:
        """Mean and population variance of p d1 first + q dk r4."""
        u = [c("_r1") * c(first), c("_t") * c(first), c(f"_r{k}") * r4, c("_t") * r4]
        g = [p, -p * a[1], q, -q * a[k]]
        e = sum((gi * mean(ui) for gi, ui in zip(g[1:], u[1:], strict=True)), g[0] * mean(u[0]))
        square = sum((g[i] * g[j] * mean(u[i] * u[j]) for i in range(4) for j in range(4)), F.lit(0.0))
        return e, square

    (e1, s1), (e2, s2) = moments(names[1], 3), moments(names[2], 5)
    rows = rows.withColumns({"_e1": e1, "_s1": s1, "_e2": e2, "_s2": s2})
    v1, v2 = c("_s1") - c("_e1") * c("_e1"), c("_s2") - c("_e2") * c("_e2")
    square = F.when(v1 + v2 > 0, (v2 * c("_e1") + v1 * c("_e2")) / F.nullif(v1 + v2, F.lit(0.0)))
    good = (c("_n") >= window - 1) & (c("_pt") * c("_n") >= 2) & (c("_po") > 0) & (c("_pc") > 0)
    return unblocked(rows.withColumn("spread", F.when(good, F.sqrt(F.abs(square))))).select(*bars.columns, "spread")


def filled(bars: DataFrame) -> DataFrame:
    """``spread`` with gaps filled by the median so far, else 2e-5, and kept between 0.5 and 10 basis points."""
    rows = expanding_median(bars, "spread", "_median")
    return rows.withColumn("spread", clipped(F.coalesce("spread", "_median", F.lit(2e-5)), 5e-5, 1e-3)).drop("_median")
