"""Mean-reversion priors of regime transitions: runs, segments, AR(1) speeds and volatility ratios.

Everything is relational: runs are numbered by their first position, segments are joined by position, slopes are
aggregates. A prior is one row of (source, dest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.guards import ln, ratio
from tidemill.operators.order import blocked, carried, indexed, over, unblocked
from tidemill.operators.regime import transitions

LN2 = 0.6931471805599453


def runs(bars: DataFrame) -> DataFrame:
    """Bars with the first position of their run of one regime (``run``)."""
    rows = transitions(bars)
    starts = F.when(F.col("is_transition") | (F.col("i") == 0), F.col("i"))
    return carried(rows, starts, "run")


def segments(bars: DataFrame, window: int = 48) -> DataFrame:
    """The first ``window`` bars of each run that follows a transition: asset, run, source, dest, k (place in it) and close."""
    rows = runs(bars)
    heads = rows.where("is_transition").select("asset", "run", F.col("previous").alias("source"), F.col("regime").alias("dest"))
    own = rows.select("asset", "run", "i", "ts", "close", (F.col("i") - F.col("run")).alias("k")).where(F.col("k") < window)
    return own.join(heads, ["asset", "run"])


def segment_speeds(bars: DataFrame, window: int = 48) -> DataFrame:
    """Per segment of 5 prices or more: the slope of price on the price before, and theta = -ln(slope) where valid."""
    parts = segments(bars, window)
    before = F.lag("close").over(Window.partitionBy("asset", "run").orderBy("k"))
    pairs = parts.withColumn("_x", before)
    found = pairs.groupBy("asset", "run", "source", "dest").agg(F.count("*").alias("n_prices"), F.regr_slope("close", "_x").alias("slope"))
    good = (F.col("n_prices") >= 5) & (F.col("slope") > 0) & (F.col("slope") < 1)
    theta = F.when(good, -ln(F.col("slope")))
    return found.withColumn("theta", F.when(theta.between(0.001, 5.0), theta))


def pooled_speed(bars: DataFrame, window: int, least_prices: int, least_returns: int) -> DataFrame:
    """Per transition: the AR(1) slope of all its segments' log returns, one after the other.

    A transition's returns are placed by running totals, then each is paired with the one before it inside blocks of places.
    """
    parts = segments(bars, window)
    by_run = Window.partitionBy("asset", "run")
    rows = parts.withColumn("_r", ln(F.col("close") / F.lag("close").over(by_run.orderBy("k")))).withColumn("_n", F.count("*").over(by_run))
    returns = rows.where((F.col("_n") >= least_prices) & F.col("_r").isNotNull())
    placed = indexed(returns.withColumn("_pool", F.concat_ws("|", "asset", "source", "dest")), "_pool", ("ts",), "_place")
    pairs = unblocked(blocked(placed, back=1, i="_place").withColumn("_x", F.lag("_r").over(over("_pool", "_place"))))
    found = pairs.groupBy("asset", "source", "dest").agg(F.count("*").alias("n_returns"), F.regr_slope("_r", "_x").alias("slope"))
    good = (F.col("n_returns") >= least_returns) & (F.col("slope") > 0) & (F.col("slope") < 1)
    return found.withColumn("theta", F.when(good, -ln(F.col("slope"))))


def volatility_ratios(bars: DataFrame, lookback: int = 30, own_run: bool = False) -> DataFrame:
    """Per transition bar: deviation of log returns of the ``lookback`` prices from it, over that of those before it.

    With ``own_run`` the prices before are those of the run that ends there only.
    """
    rows = runs(bars).select("asset", "i", "run", "close", "is_transition", "previous", "regime")
    heads = rows.where("is_transition").select("asset", F.col("i").alias("at"), F.col("previous").alias("source"), F.col("regime").alias("dest"))
    places = heads.withColumn("_i", F.explode(F.sequence(F.greatest(F.col("at") - lookback, F.lit(0)), F.col("at") + lookback - 1)))
    near = places.join(rows.select("asset", F.col("i").alias("_i"), "close", "run"), ["asset", "_i"])
    near = near.withColumn("_after", F.col("_i") >= F.col("at"))
    if own_run:
        last = F.max(F.when(~F.col("_after"), F.col("run"))).over(Window.partitionBy("asset", "at"))
        near = near.withColumn("_last", last).where(F.col("_after") | (F.col("run") == F.col("_last")))
    step = F.lag("close").over(Window.partitionBy("asset", "at", "_after").orderBy("_i"))
    moves = near.withColumn("_r", ln(F.col("close") / step))
    side = lambda after: F.stddev_samp(F.when(F.col("_after") == after, F.col("_r")))
    count = lambda after: F.count_if(F.col("_after") == after)
    found = moves.groupBy("asset", "at", "source", "dest").agg(side(True).alias("dest_vol"), side(False).alias("source_vol"), count(True).alias("_nd"), count(False).alias("_ns"))
    enough = (F.col("_nd") >= 3) & (F.col("_ns") >= 3) & (F.col("dest_vol") > 1e-8) & (F.col("source_vol") > 1e-8)
    value = F.when(enough, ratio(F.col("dest_vol"), F.col("source_vol")))
    return found.withColumn("vol_ratio", F.when(value.between(0.1, 5.0), value)).drop("_nd", "_ns")


def _half_life(theta: Column) -> Column:
    return F.bround(LN2 / theta, 2)


def priors(bars: DataFrame, window: int = 48, lookback: int = 30) -> DataFrame:
    """Priors from segment speeds: medians, counts, and fallbacks 0.20 (speed), 0.85 (ratio)."""
    keys = ["asset", "source", "dest"]
    speeds = segment_speeds(bars, window).groupBy(*keys).agg(F.median("theta").alias("_theta"), F.count("*").alias("n_transitions"), F.count("theta").alias("n_valid_thetas"))
    pooled = pooled_speed(bars, window, 4, 10).select(*keys, F.col("theta").alias("_pooled"))
    vols = volatility_ratios(bars, lookback).groupBy(*keys).agg(F.median("vol_ratio").alias("_ratio"), F.count("vol_ratio").alias("n_valid_vol_ratios"))
    found = speeds.join(pooled, keys, "left").join(vols, keys, "left").withColumn("_t", F.coalesce("_theta", "_pooled", F.lit(0.20)))
    return found.select(
        *keys, F.bround("_t", 4).alias("theta_median"), _half_life(F.col("_t")).alias("half_life_median_bars"), F.bround(F.coalesce("_ratio", F.lit(0.85)), 4).alias("vol_ratio_median"),
        "n_transitions", "n_valid_thetas", F.coalesce("n_valid_vol_ratios", F.lit(0)).alias("n_valid_vol_ratios"), (F.col("n_valid_thetas") == 0).alias("fallback_used"),
    )


def pooled_priors(bars: DataFrame, window: int = 48, lookback: int = 30) -> DataFrame:
    """Priors from pooled returns and run-limited ratios: speed in [0.01, 2], fallbacks 0.35 and 0.70."""
    keys = ["asset", "source", "dest"]
    heads = transitions(bars).where("is_transition").groupBy("asset", F.col("previous").alias("source"), F.col("regime").alias("dest")).agg(F.count("*").alias("n_segments"))
    speed = pooled_speed(bars, window, 2, 5).select(*keys, F.when(F.col("theta").between(0.01, 2.0), F.col("theta")).alias("_theta"))
    vols = volatility_ratios(bars, lookback, own_run=True).where((F.col("vol_ratio") > 0.1) & (F.col("vol_ratio") < 5.0))
    vols = vols.groupBy(*keys).agg(F.median("vol_ratio").alias("_median"), F.avg("vol_ratio").alias("_mean"), F.stddev_pop("vol_ratio").alias("_std"), F.count("*").alias("n_vol_ratio_valid"))
    found = heads.join(speed, keys, "left").join(vols, keys, "left")
    return found.select(
        *keys, F.coalesce("_theta", F.lit(0.35)).alias("theta"), F.coalesce("_median", F.lit(0.70)).alias("vol_ratio_median"), F.coalesce("_mean", F.lit(0.70)).alias("vol_ratio_mean"),
        F.coalesce("_std", F.lit(0.0)).alias("vol_ratio_std"), "n_segments", F.coalesce("n_vol_ratio_valid", F.lit(0)).alias("n_vol_ratio_valid"),
        F.col("_theta").isNull().alias("theta_fallback_used"), F.col("_median").isNull().alias("vol_ratio_fallback_used"),
    )


def batch_priors(bars: DataFrame, states: tuple[str, ...] = ("expansion", "ranging")) -> DataFrame:
    """``pooled_priors`` of every model (the ``asset``) and transition between the states; what a model lacks are fallback rows."""
    moves = F.explode(F.array(*[F.struct(F.lit(x).alias("source"), F.lit(y).alias("dest")) for x in states for y in states if x != y])).alias("_move")
    wanted = bars.groupBy("asset").agg(F.count_distinct("regime").alias("n_regimes")).select("asset", "n_regimes", moves).select("asset", "n_regimes", "_move.*")
    found = wanted.join(pooled_priors(bars), ["asset", "source", "dest"], "left")
    filled = {"theta": 0.35, "vol_ratio_median": 0.70, "vol_ratio_mean": 0.70, "vol_ratio_std": 0.0, "n_segments": 0, "n_vol_ratio_valid": 0, "theta_fallback_used": True, "vol_ratio_fallback_used": True}
    return found.select(F.col("asset").alias("model"), "source", "dest", "n_regimes", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in filled.items()])


def fallback_summary(batch: DataFrame) -> DataFrame:
    """Fallbacks by model, and its place among all, the one with most first."""
    found = batch.groupBy("model").agg(F.count("*").alias("n_transitions"), F.count_if("theta_fallback_used").alias("n_theta_fallbacks"), F.count_if("vol_ratio_fallback_used").alias("n_vol_fallbacks"))
    worst = Window.orderBy(F.desc(F.col("n_theta_fallbacks") + F.col("n_vol_fallbacks")), "model")  # a row a model
    return found.withColumn("worst", F.row_number().over(worst))


def written(priors: DataFrame, path: str) -> None:
    """Priors as JSON, one line each; a row a model and transition, so one file."""
    priors.coalesce(1).write.mode("overwrite").json(path)
