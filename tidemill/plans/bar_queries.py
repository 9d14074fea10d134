"""Registered queries over bars: each beside the SQL that gives the same rows.

The bars are a walk over the driver's events (see ``sources.ticks``). The tables span thirty days, so windows are scaled
down: gate of 5 days and 100 rows, kernels of 50 bars, folds of 10 days and 2 days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.guards import rounded
from tidemill.operators import backtest, bars, events, folds, joins, ou, regime, regression, rolling, running, signatures, spread
from tidemill.operators.order import indexed
from tidemill.plans.catalog import register
from tidemill.scratch import prepared
from tidemill.sources.ticks import ticks

H, DAYS, LEAST, N = 24, 5, 100, 50
KERNEL = (1.0, 1.0, 1.5, 5.0)
SCALES = [events.Scale("small_dc", 0.0008, 20, 2.0), events.Scale("mid_dc", 0.0015, 30, 2.0), events.Scale("max_dc", 0.0025, 50, 1.0)]

# ---- the same steps in SQL -------------------------------------------------------------------------------------------

TICKS = "ticks AS (SELECT ts, event_id, 1000.0 * exp(1e-7 * sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (ORDER BY ts, event_id)) AS price FROM events)"
B0 = (
    TICKS + ", b0 AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*) AS n_ticks FROM ticks GROUP BY 1)"
)
GK_SQL = "greatest(0.0, 0.5 * ln(high / low) * ln(high / low) - 0.3862943611198906 * ln(close / open) * ln(close / open))"
BARS = (
    B0
    + f""", b1 AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i, lag(ts) OVER (ORDER BY ts) AS pts, lag(close) OVER (ORDER BY ts) AS pc, {GK_SQL} AS gk_var FROM b0),
bars AS (SELECT ts, open, high, low, close, n_ticks, i, (pts IS NULL OR ts - pts > INTERVAL '5 minutes') AS is_gap, coalesce(epoch_us(ts) - epoch_us(pts), 0) / 60e6 AS gap_minutes, ln(close / pc) AS return_c2c_raw,
  CASE WHEN pts IS NULL OR ts - pts > INTERVAL '5 minutes' THEN ln(close / open) ELSE ln(close / pc) END AS "return", gk_var, sqrt(gk_var) AS gk_bar FROM b1)"""
)


def _frame(a: str, b: str = "CURRENT ROW") -> str:
    return f"(ORDER BY i ROWS BETWEEN {a} AND {b})"


ROLLED = (
    BARS
    + f""", rolled AS (SELECT *, CASE WHEN count(gk_var) OVER {_frame('23 PRECEDING')} >= 24 THEN sqrt(greatest(sum(gk_var) OVER {_frame('23 PRECEDING')}, 0)) END AS rv_trail,
  CASE WHEN count(gk_var) OVER {_frame('1 FOLLOWING', '24 FOLLOWING')} >= 24 THEN sqrt(greatest(sum(gk_var) OVER {_frame('1 FOLLOWING', '24 FOLLOWING')}, 0)) END AS rv_fwd,
  CASE WHEN count(close) OVER {_frame('29 PRECEDING')} >= 30 THEN (close - avg(close) OVER {_frame('29 PRECEDING')}) / nullif(stddev_pop(close) OVER {_frame('29 PRECEDING')}, 0) END AS z_score FROM bars)"""
)


def _gated(share: float) -> str:
    near = "(ORDER BY ts RANGE BETWEEN INTERVAL '431999 seconds 999999 microseconds' PRECEDING AND CURRENT ROW)"
    return (
        ROLLED
        + f""", sig AS (SELECT *, CASE WHEN rv_trail IS NOT NULL THEN round(greatest(rv_trail, 5e-4), 9) END AS sigma_hat FROM rolled),
g0 AS (SELECT *, CASE WHEN count(sigma_hat) OVER {near} >= 100 THEN quantile_cont(sigma_hat, {share}) OVER {near} END AS regime_threshold FROM sig),
gated AS (SELECT *, CASE WHEN sigma_hat <= regime_threshold THEN 'ranging' ELSE 'expansion' END AS regime FROM g0)"""
    )


GATED = _gated(0.5)
MOVED = GATED + ", moved AS (SELECT *, lag(regime) OVER (ORDER BY i) AS previous, coalesce(lag(regime) OVER (ORDER BY i) <> regime, false) AS is_transition FROM gated)"
SINCE = MOVED + ", since AS (SELECT *, i - max(CASE WHEN is_transition THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS bars_since FROM moved)"
SIGNALS = (
    SINCE
    + """, s0 AS (SELECT *, sigma_hat * close AS delta_p, CASE WHEN regime = 'ranging' AND round(z_score, 6) <= -1.5 THEN 1 WHEN regime = 'ranging' AND round(z_score, 6) >= 1.5 THEN -1 ELSE 0 END AS signal FROM since),
signals AS (SELECT *, CASE WHEN signal <> 0 THEN close - signal * delta_p END AS stop_price, CASE WHEN signal <> 0 THEN close + signal * delta_p END AS target_price, CASE WHEN signal <> 0 THEN i + 24 ELSE -1 END AS time_stop_bar FROM s0)"""
)

# ---- the same steps in Spark -----------------------------------------------------------------------------------------


def bars_5m(spark: SparkSession, sf_dir: str, assets: bool = False) -> DataFrame:
    """Five-minute bars of the walk; with ``assets``, of one walk for each type of event."""
    return bars.resample(ticks(spark, sf_dir, assets=assets))


def rich(spark: SparkSession, sf_dir: str, assets: bool = False) -> DataFrame:
    """Bars with positions, gaps, returns and variance."""
    return bars.enriched(bars_5m(spark, sf_dir, assets))


def rolled(spark: SparkSession, sf_dir: str, assets: bool = False) -> DataFrame:
    """Bars with volatilities and z-score."""
    return rolling.with_rolling(rich(spark, sf_dir, assets), 30, H, **rolling.realized(H), z_score=rolling.zscore(30))


def gated(spark: SparkSession, sf_dir: str, share: float = 0.5, assets: bool = False) -> DataFrame:
    """Bars with the regime of trailing volatility."""
    sigma = F.when(F.col("rv_trail").isNotNull(), F.round(F.greatest("rv_trail", F.lit(regime.SIGMA_FLOOR)), 9))
    return regime.gate(rolled(spark, sf_dir, assets).withColumn("sigma_hat", sigma), days=DAYS, least=LEAST, share=share)


def since(spark: SparkSession, sf_dir: str, assets: bool = False) -> DataFrame:
    """Bars with transitions and the bars since the last."""
    return regime.since_transition(regime.transitions(gated(spark, sf_dir, assets=assets)))


def signalled(spark: SparkSession, sf_dir: str, assets: bool = False, **options) -> DataFrame:
    """Bars with signals."""
    return regime.signals(since(spark, sf_dir, assets).withColumn("z_score", F.round("z_score", 6)), z_threshold=1.5, h=H, **options)


def _chosen(df: DataFrame, *columns: str, digits: int = 6, **own: int) -> DataFrame:
    return rounded(df.select(*columns), digits, **own)


def _r(columns: str, digits: int = 6, **own: int) -> str:
    """A select list with rounded numbers: ``name`` plain, ``~name`` rounded."""
    return ", ".join(f'round("{c[1:]}", {own.get(c[1:], digits)}) AS "{c[1:]}"' if c[0] == "~" else f'"{c}"' for c in columns.split())


def plain(name: str, build, columns: str, sql: str | None, source: str = "", digits: int = 6, **own: int) -> None:
    """Register a query that selects columns of a frame, and the same columns of a SQL relation."""
    names = [c.lstrip("~") for c in columns.split()]
    register(name, lambda spark, sf_dir: _chosen(build(spark, sf_dir), *names, digits=digits, **own), sql and f"WITH {sql} SELECT {_r(columns, digits, **own)} FROM {source}")


plain("ticks_walk", ticks, "ts event_id ~price", TICKS, "ticks")
plain("bars_5m", bars_5m, "ts ~open ~high ~low ~close n_ticks", B0, "b0")
plain("gap_flags", rich, "ts i is_gap ~gap_minutes", BARS, "bars")
plain("gap_aware_returns", rich, "ts ~return ~return_c2c_raw is_gap", BARS, "bars", 9)
plain("garman_klass", lambda s, d: rich(s, d).withColumn("gk_ppm", F.col("gk_var") * 1e6), "ts ~gk_ppm ~gk_bar", BARS.replace("sqrt(gk_var) AS gk_bar FROM b1", "sqrt(gk_var) AS gk_bar, gk_var * 1e6 AS gk_ppm FROM b1"), "bars")
plain("bar_features", rolled, "ts i ~open ~high ~low ~close ~return is_gap ~rv_trail ~rv_fwd ~z_score", ROLLED, "rolled", **{"return": 9, "rv_trail": 9, "rv_fwd": 9})
plain("rv_trailing_forward", rolled, "ts ~rv_trail ~rv_fwd", ROLLED, "rolled", 9)
plain("zscore_30", rolled, "ts ~z_score", ROLLED, "rolled")
register(
    "bars_1h_by_asset",
    lambda s, d: rounded(bars.resample(ticks(s, d, assets=True), "1 hour").drop("n_ticks")),
    "WITH t AS (SELECT event_type AS asset, ts, 1000.0 * exp(1e-7 * sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS price FROM events) "
    "SELECT asset, time_bucket(INTERVAL '1 hour', ts) AS ts, round(arg_min(price, ts), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, ts), 6) AS close FROM t GROUP BY 1, 2",
)
register(
    "bars_15m_from_5m",
    lambda s, d: rounded(bars.resample_bars(bars_5m(s, d), "15 minutes").drop("asset")),
    f"WITH {B0} SELECT time_bucket(INTERVAL '15 minutes', ts) AS ts, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close FROM b0 GROUP BY 1",
)
register(
    "bar_summary",
    lambda s, d: rounded(bars.typical_spread(rich(s, d))),
    f"WITH {BARS} SELECT count(*) AS n_bars, count(*) FILTER (is_gap) AS n_gaps, round(count(*) FILTER (is_gap) / count(*), 6) AS gap_share, round(max(abs(return_c2c_raw)), 6) AS max_raw, round(max(abs(\"return\")), 6) AS max_clean, round(avg(gk_var) * 1e6, 6) AS gk_mean, round(stddev_samp(gk_var) * 1e6, 6) AS gk_std FROM bars",
)
register(
    "validate_ohlc",
    lambda s, d: bars.validate(bars_5m(s, d)),
    f"WITH {B0} SELECT count(*) AS n_rows, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR ts IS NULL) AS n_null, count(*) FILTER (high < low) AS n_high_low, count(*) FILTER (high < greatest(open, close)) AS n_high_body, count(*) FILTER (low > least(open, close)) AS n_low_body, count(*) FILTER (least(open, high, low, close) <= 0) AS n_not_positive FROM b0",
)
register(
    "moving_averages",
    lambda s, d: rounded(rolling.with_rolling(rich(s, d), 7, ma_5=rolling.moving_average("close", 5), ma_7=rolling.moving_average("close", 7)).select("ts", "ma_5", "ma_7")),
    f"WITH {BARS} SELECT ts, round(avg(close) OVER {_frame('4 PRECEDING')}, 6) AS ma_5, round(avg(close) OVER {_frame('6 PRECEDING')}, 6) AS ma_7 FROM bars",
)

_METRICS = (
    BARS
    + f""", m0 AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY i)) > 20 * 60000000, false) AS sampler_gap FROM bars),
m1 AS (SELECT *, CASE WHEN NOT sampler_gap THEN ln(close / lag(close) OVER (ORDER BY i)) END AS r, CASE WHEN NOT sampler_gap THEN close END AS p FROM m0),
m2 AS (SELECT *, abs(p - lag(p) OVER (ORDER BY i)) AS d1, abs(p - lag(p, 2) OVER (ORDER BY i)) AS d2 FROM m1),
m3 AS (SELECT *, CASE WHEN count(r) OVER {_frame('29 PRECEDING')} >= 30 THEN stddev_samp(r) OVER {_frame('29 PRECEDING')} END AS s, CASE WHEN count(d1) OVER {_frame('29 PRECEDING')} >= 30 THEN sum(d1) OVER {_frame('29 PRECEDING')} END AS a1,
  CASE WHEN count(d2) OVER {_frame('29 PRECEDING')} >= 30 THEN sum(d2) OVER {_frame('29 PRECEDING')} END AS a2 FROM m2),
m4 AS (SELECT *, avg(s) OVER {_frame('287 PRECEDING')} AS sr, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN least(greatest(log2(greatest(a2 / (a1 + 1e-10), 1e-10)), 0.05), 0.95) ELSE 0.5 END AS hu FROM m3),
m5 AS (SELECT *, coalesce(CASE WHEN sr > 0 THEN s / sr END, 1.0) AS v, exp(2.0 * (0.5 - hu)) AS f FROM m4),
metrics AS (SELECT ts, i, sampler_gap, lag(s) OVER (ORDER BY i) AS sigma_t, lag(sr) OVER (ORDER BY i) AS sigma_ref, coalesce(lag(v) OVER (ORDER BY i), 1.0) AS energy_v, coalesce(lag(hu) OVER (ORDER BY i), 0.5) AS hurst,
  coalesce(lag(f) OVER (ORDER BY i), 1.0) AS fractal_f, coalesce(lag(0.002 * v * f) OVER (ORDER BY i), 0.002) AS theta_dynamic FROM m5)"""
)
_fractal = lambda s, d: rolling.fractal_metrics(rich(s, d), gap_minutes=20.0)
plain("rolling_volatility", _fractal, "ts ~sigma_t ~sigma_ref ~energy_v", _METRICS, "metrics", sigma_t=9, sigma_ref=9)
plain("hurst_kn", _fractal, "ts ~hurst ~fractal_f", _METRICS, "metrics")
plain("dynamic_theta", _fractal, "ts sampler_gap ~theta_dynamic", _METRICS, "metrics", 8)
register(
    "tspl_weights",
    lambda s, d: rounded(s.range(1).select(F.posexplode(rolling.power_law(1.5, 5.0, N)).alias("lag", "weight")).withColumn("lag", F.col("lag") + 1), 9),
    f"WITH w AS (SELECT i AS lag, (i + 5.0) ** -1.5 AS x FROM range(1, {N + 1}) t(i)) SELECT CAST(lag AS INTEGER) AS lag, round(x / sum(x) OVER (), 9) AS weight FROM w",
)
_KERNEL = (
    BARS
    + f""", k0 AS (SELECT i AS l, (i + 1.0) ** -1.0 AS x, (i + 5.0) ** -1.5 AS y FROM range(1, {N + 1}) t(i)), k AS (SELECT l, x / sum(x) OVER () AS w1, y / sum(y) OVER () AS w2 FROM k0),
kern AS (SELECT b.ts, coalesce(sum(p."return" * w1), 0) AS r1, coalesce(sum(p."return" * p."return" * w2), 0) * 1e6 AS r2_ppm FROM bars b CROSS JOIN k LEFT JOIN bars p ON p.i = b.i - k.l GROUP BY b.ts)"""
)
_kernel = lambda s, d: rolling.kernel_features(rich(s, d), *KERNEL, n=N).withColumn("r2_ppm", F.col("r2") * 1e6)
plain("kernel_r1_r2", _kernel, "ts ~r1 ~r2_ppm", _KERNEL, "kern", r1=9, r2_ppm=5)



def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatilities and kernel sums of each bar, from two prepared tables that meet without an exchange."""
    own = prepared(rolled(spark, sf_dir).select("asset", "ts", "rv_trail", "z_score"))
    return own.join(prepared(_kernel(spark, sf_dir).select("asset", "ts", "r1", "r2_ppm")), ["asset", "ts"])


plain("prepared_join", _prepared, "ts ~rv_trail ~z_score ~r1 ~r2_ppm", _KERNEL + ", " + ROLLED.removeprefix(BARS + ", ") + ", pj AS (SELECT ts, rv_trail, z_score, r1, r2_ppm FROM rolled JOIN kern USING (ts))", "pj", rv_trail=9, r1=9, r2_ppm=5)

plain("regime_gate_median", gated, "ts ~sigma_hat ~regime_threshold regime", GATED, "gated", 12)
plain("regime_gate_tercile", lambda s, d: gated(s, d, 0.3333), "ts ~regime_threshold regime", _gated(0.3333), "gated", 12)
plain("regime_transitions", lambda s, d: since(s, d).where("is_transition"), "ts i previous regime", MOVED, "moved WHERE is_transition")
plain("bars_since_transition", since, "ts bars_since", SINCE, "since")
_SIG = "ts regime ~z_score ~delta_p signal ~stop_price ~target_price time_stop_bar"
plain("signals", signalled, _SIG, SIGNALS, "signals")
_TILT = SIGNALS.replace("FROM since)", "FROM since JOIN (SELECT ts AS kts, r1 FROM kern) ON kts = ts)").replace(
    "round(z_score, 6) <= -1.5 THEN", "round(z_score, 6) <= -1.5 AND round(r1, 12) <= 0 THEN"
).replace("round(z_score, 6) >= 1.5 THEN", "round(z_score, 6) >= 1.5 AND round(r1, 12) >= 0 THEN")
_TILT = _KERNEL + ", " + _TILT.removeprefix(BARS + ", ")


def _tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = _kernel(spark, sf_dir).select("asset", "ts", F.round("r1", 12).alias("r1"), F.lit(1).alias("beta1_sign"))
    rows = since(spark, sf_dir).withColumn("z_score", F.round("z_score", 6)).join(kernel, ["asset", "ts"])
    return regime.signals(rows, z_threshold=1.5, h=H, tilt=True)


plain("signals_beta_tilt", _tilted, "ts signal ~stop_price ~target_price", _TILT, "signals")
plain("transition_gap_gate", lambda s, d: regime.gap_gate(signalled(s, d), 24), "ts signal", SIGNALS + ", gate AS (SELECT ts, CASE WHEN bars_since <= 24 THEN signal ELSE 0 END AS signal FROM signals)", "gate")
plain("transition_gap_gate_long", lambda s, d: regime.gap_gate(signalled(s, d), 24, long_only=True), "ts signal", SIGNALS + ", gate AS (SELECT ts, CASE WHEN bars_since <= 24 AND signal > 0 THEN signal ELSE 0 END AS signal FROM signals)", "gate")


def _hurst_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurst = _fractal(spark, sf_dir).select("asset", "ts", F.round("hurst", 8).alias("hurst"))
    return regime.gap_gate(signalled(spark, sf_dir).join(hurst, ["asset", "ts"], "left"), 24, hurst_most=0.6)


plain(
    "hurst_gate", _hurst_gated, "ts signal",
    SIGNALS + ", " + _METRICS.removeprefix(BARS + ", ") + ", gate AS (SELECT s.ts, CASE WHEN bars_since <= 24 AND round(m.hurst, 8) <= 0.6 THEN signal ELSE 0 END AS signal FROM signals s LEFT JOIN metrics m ON m.ts = s.ts)", "gate",
)
plain("expanding_median", lambda s, d: running.expanding_median(gated(s, d), "sigma_hat", "median_so_far"), "ts ~median_so_far", GATED + ", em AS (SELECT ts, quantile_cont(sigma_hat, 0.5) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS median_so_far FROM gated)", "em", 12)
_OU = (
    BARS
    + f""", o0 AS (SELECT ts, i, ln(close) AS y, ln(lag(close) OVER (ORDER BY i)) AS x FROM bars),
o1 AS (SELECT *, count(x) OVER {_frame('29 PRECEDING')} AS n, regr_slope(y, x) OVER {_frame('29 PRECEDING')} AS b FROM o0),
o2 AS (SELECT ts, CASE WHEN n >= 30 AND isfinite(b) AND b > 0 AND b < 0.999 THEN -ln(b) END AS ou_theta FROM o1), o3 AS (SELECT ts, ou_theta, 0.6931471805599453 / nullif(ou_theta, 0) AS ou_half_life FROM o2)"""
)
plain("rolling_ou", lambda s, d: rolling.rolling_ou(rich(s, d)), "ts ~ou_theta ~ou_half_life", _OU, "o3", 4)

# ---- several series side by side -------------------------------------------------------------------------------------


def _by_asset(sql: str) -> str:
    """The SQL of one series as that of one a type of event: all windows and groups by series as well."""
    for one, many in (
        ("OVER (ORDER BY", "OVER (PARTITION BY asset ORDER BY"), ("ticks AS (SELECT ts,", "ticks AS (SELECT event_type AS asset, ts,"), ("b0 AS (SELECT time_bucket", "b0 AS (SELECT asset, time_bucket"),
        ("FROM ticks GROUP BY 1)", "FROM ticks GROUP BY 1, 2)"), ("bars AS (SELECT ts,", "bars AS (SELECT asset, ts,"), ("em AS (SELECT ts,", "em AS (SELECT asset, ts,"),
        ("o0 AS (SELECT ts,", "o0 AS (SELECT asset, ts,"), ("o2 AS (SELECT ts,", "o2 AS (SELECT asset, ts,"), ("o3 AS (SELECT ts,", "o3 AS (SELECT asset, ts,"),
        ("metrics AS (SELECT ts,", "metrics AS (SELECT asset, ts,"),
    ):
        sql = sql.replace(one, many)
    return sql


_EM = GATED + ", em AS (SELECT ts, quantile_cont(sigma_hat, 0.5) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS median_so_far FROM gated)"
plain("bar_features_by_asset", lambda s, d: rolled(s, d, True), "asset ts i ~open ~close ~return is_gap ~rv_trail ~rv_fwd ~z_score", _by_asset(ROLLED), "rolled", **{"return": 9, "rv_trail": 9, "rv_fwd": 9})
plain("signals_by_asset", lambda s, d: signalled(s, d, True), "asset " + _SIG, _by_asset(SIGNALS), "signals")
plain("regime_transitions_by_asset", lambda s, d: since(s, d, True).where("is_transition"), "asset ts i previous regime", _by_asset(MOVED), "moved WHERE is_transition")
plain("expanding_median_by_asset", lambda s, d: running.expanding_median(gated(s, d, assets=True), "sigma_hat", "median_so_far"), "asset ts ~median_so_far", _by_asset(_EM), "em", 12)
plain("rolling_ou_by_asset", lambda s, d: rolling.rolling_ou(rich(s, d, True)), "asset ts ~ou_theta ~ou_half_life", _by_asset(_OU), "o3", 4)
plain("hurst_kn_by_asset", lambda s, d: rolling.fractal_metrics(rich(s, d, True), gap_minutes=20.0), "asset ts ~hurst ~fractal_f", _by_asset(_METRICS), "metrics")
