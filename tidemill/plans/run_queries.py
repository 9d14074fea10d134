"""Registered queries of whole strategy runs, with parameters frozen on the folds before the holdout, beside their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.guards import rounded
from tidemill.operators import ou, regime, runs
from tidemill.plans import bar_queries as b
from tidemill.plans import strategy_queries as q
from tidemill.plans.bar_queries import DAYS, H, LEAST
from tidemill.plans.catalog import register
from tidemill.scratch import kept

#: The holdout begins here; stops at 1.5, targets at 1 times the forecast move.
HOLDOUT, K1 = "2024-01-25", 1.5
EDGE = {"flat": q.FLAT, "h": H, "k1": K1}

# ---- the same steps in SQL -------------------------------------------------------------------------------------------


def _features_sql(k: str, source: str, share: float) -> str:
    """Features of the bars in ``source`` (ts, close, sigma_hat, r1, beta1_sign), names marked with ``k``."""
    near = f"(ORDER BY ts RANGE BETWEEN INTERVAL '{DAYS * 86400 - 1} seconds 999999 microseconds' PRECEDING AND CURRENT ROW)"
    f = b._frame("29 PRECEDING")
    return f"""fi{k} AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM {source}),
fz{k} AS (SELECT *, round(CASE WHEN count(close) OVER {f} >= 30 THEN (close - avg(close) OVER {f}) / nullif(stddev_pop(close) OVER {f}, 0) END, 6) AS z_score FROM fi{k}),
fg{k} AS (SELECT *, CASE WHEN count(sigma_hat) OVER {near} >= {LEAST} THEN quantile_cont(sigma_hat, {share}) OVER {near} END AS regime_threshold FROM fz{k}),
fr{k} AS (SELECT *, CASE WHEN sigma_hat <= regime_threshold THEN 'ranging' ELSE 'expansion' END AS regime FROM fg{k}), fp{k} AS (SELECT *, lag(regime) OVER (ORDER BY i) AS previous FROM fr{k}),
ff{k} AS (SELECT *, i - max(CASE WHEN previous = 'expansion' AND regime = 'ranging' THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS bars_since FROM fp{k})"""


def _signals_sql(k: str, source: str, tilt: bool, where: str = "true", join: str = "") -> str:
    """Signals ``sig<k>`` of features, those that break a condition set to 0."""
    long, short = ("AND beta1_sign * r1 <= 0", "AND beta1_sign * r1 >= 0") if tilt else ("", "")
    raw = f"CASE WHEN regime = 'ranging' AND z_score <= -1.5 {long} THEN 1 WHEN regime = 'ranging' AND z_score >= 1.5 {short} THEN -1 ELSE 0 END"
    return f"sr{k} AS (SELECT *, {raw} AS raw FROM {source}), sig{k} AS (SELECT s.* EXCLUDE (raw), CASE WHEN {where.replace('signal', 'raw')} THEN raw ELSE 0 END AS signal FROM sr{k} s {join})"


BASE = (
    q.NUMBERED.replace("rv_trail IS NOT NULL)", f"rv_trail IS NOT NULL AND ts < TIMESTAMP '{HOLDOUT}')")
    + f""", dev AS (SELECT fc.ts, fc.close, round(greatest(sigma_pdv, 5e-4), 9) AS sigma_hat, round(r1, 12) AS r1, b1_sign AS beta1_sign FROM fc JOIN (SELECT ts, min(fold) AS fold FROM fc GROUP BY ts) o ON o.ts = fc.ts AND o.fold = fc.fold JOIN ols ON ols.fold = fc.fold),
hold AS (SELECT x.ts, x.close, round(greatest(o.b0 + o.b1 * kern.r1 + o.b2 * sqrt(greatest(r2_ppm, 0) / 1e6), 5e-4), 9) AS sigma_hat, round(kern.r1, 12) AS r1, b1_sign AS beta1_sign FROM bars x JOIN kern ON kern.ts = x.ts CROSS JOIN (SELECT * FROM ols ORDER BY fold DESC LIMIT 1) o WHERE x.ts >= TIMESTAMP '{HOLDOUT}'),
"""
    + q.M1 + ", " + q._edge_sql().removeprefix(b.BARS + ", ")
)


def _run_sql(parts: list[str], named: dict[str, tuple[str, float | None, bool]], cooldown: int, base: str = BASE) -> str:
    """Metrics by configuration; ``named``: name to (signals, z exit, rolling spreads)."""
    own = [f"{q._cand_sql(f'_{k}', z, edge, signals, K1)}, {q._trades_sql(f'_{k}').replace('>= 24', f'>= {cooldown}')}" for k, (signals, z, edge) in enumerate(named.values())]
    return "WITH RECURSIVE " + ", ".join([base, *parts, *own]) + " " + " UNION ALL ".join(f"(SELECT '{name}' AS config, {q._metrics_sql(f'_{k}')})" for k, name in enumerate(named))


# ---- the same steps in Spark -----------------------------------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Bars with forecasts before the holdout, holdout bars under the last fold, minutes, and rolling spreads; each written once."""
    rows = kept(q._forecasts(spark, sf_dir, until=HOLDOUT))
    dev = kept(runs.predicted(rows))
    kernel = b._kernel(spark, sf_dir).select("asset", "ts", "r1", F.sqrt("r2").alias("root_r2"))
    held = b.rich(spark, sf_dir).where(f"ts >= timestamp_ntz '{HOLDOUT}'").select("asset", "ts", "close").join(kernel, ["asset", "ts"])
    hold = kept(runs.frozen(held, rows.select("asset", "fold", "b0", "b1", "b2")))
    return dev, hold, q._minutes(spark, sf_dir), kept(q._filled(spark, sf_dir).select("asset", "ts", "spread"))


def _features(rows: DataFrame, share: float = 0.5) -> DataFrame:
    return kept(runs.features(rows, h=H, days=DAYS, least=LEAST, share=share))


_signals = lambda rows, tilt=False: regime.signals(rows, z_threshold=1.5, h=H, k1=K1, tilt=tilt)


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six configurations before the holdout, and two on it."""
    dev, hold, minutes, spreads = _inputs(spark, sf_dir)
    median, tercile, late = _features(dev), _features(dev, 0.3333), _features(hold)
    edge = EDGE | {"spreads": spreads}
    named = {
        "median_edge_z0": (_signals(median), edge | {"z_exit": 0.0}), "median_edge_z05": (_signals(median), edge | {"z_exit": -0.5}), "median_flat_z0": (_signals(median), EDGE | {"z_exit": 0.0}),
        "tercile_edge_z0": (_signals(tercile), edge | {"z_exit": 0.0}), "median_edge": (_signals(median), edge | {"z_exit": None}), "tilt_edge": (_signals(median, True), edge | {"z_exit": None}),
        "holdout_z0": (_signals(late), edge | {"z_exit": 0.0}), "holdout_tilt": (_signals(late, True), edge | {"z_exit": None}),
    }
    return rounded(runs.compared(named, minutes, 24).drop("asset"))


register(
    "run_full_strategy",
    _full,
    _run_sql(
        [_features_sql("m", "dev", 0.5), _features_sql("t", "dev", 0.3333), _features_sql("h", "hold", 0.5), *(_signals_sql(k, f, tilt) for k, f, tilt in (("m", "ffm", False), ("t", "fft", False), ("x", "ffm", True), ("h", "ffh", False), ("hx", "ffh", True)))],
        {"median_edge_z0": ("sigm", 0.0, True), "median_edge_z05": ("sigm", -0.5, True), "median_flat_z0": ("sigm", 0.0, False), "tercile_edge_z0": ("sigt", 0.0, True), "median_edge": ("sigm", None, True), "tilt_edge": ("sigx", None, True), "holdout_z0": ("sigh", 0.0, True), "holdout_tilt": ("sighx", None, True)},
        24,
    ),
)


def _gap_run(spark: SparkSession, sf_dir: str, with_hurst: bool) -> DataFrame:
    """Baseline, two-sided and long-only after transitions, before the holdout; the last two on it as well."""
    dev, hold, minutes, spreads = _inputs(spark, sf_dir)
    options = EDGE | {"spreads": spreads, "z_exit": None}
    hurst = kept(b._fractal(spark, sf_dir).select("asset", "ts", F.round("hurst", 8).alias("hurst"))) if with_hurst else None
    own, late = (_signals(_features(rows), True) for rows in (dev, hold))
    named = {"baseline": own} | runs.gated(own, 48, hurst) | {f"holdout_{k}": v for k, v in runs.gated(late, 48, hurst).items()}
    return rounded(runs.compared({k: (v, options) for k, v in named.items()}, minutes, 12).drop("asset"))


def _gap_sql(with_hurst: bool) -> str:
    join = "LEFT JOIN (SELECT ts AS hts, round(hurst, 8) AS hurst FROM metrics) hu ON hu.hts = s.ts" if with_hurst else ""
    near = "bars_since <= 48" + (" AND hurst <= 0.6" if with_hurst else "")
    parts = [_features_sql("m", "dev", 0.5), _features_sql("h", "hold", 0.5), _signals_sql("b", "ffm", True)]
    parts += [_signals_sql(f"{k}{side}", f"ff{k}", True, near + (" AND signal > 0" if side == "l" else ""), join) for k in ("m", "h") for side in ("t", "l")]
    extra = [b._METRICS.removeprefix(b.BARS + ", ").replace("m0 AS", "fm0 AS").replace("FROM m0", "FROM fm0").replace("m1 AS", "fm1 AS").replace("FROM m1", "FROM fm1")] if with_hurst else []  # m0 and m1 are the minutes here
    return _run_sql(extra + parts, {"baseline": ("sigb", None, True), "two_sided": ("sigmt", None, True), "long_only": ("sigml", None, True), "holdout_two_sided": ("sight", None, True), "holdout_long_only": ("sighl", None, True)}, 12)


register("run_transition_strategy", lambda s, d: _gap_run(s, d, False), _gap_sql(False))
register("run_integrated_strategy", lambda s, d: _gap_run(s, d, True), _gap_sql(True))

# ---- batch calibration -----------------------------------------------------------------------------------------------

MODELS = {"median": 0.5, "tercile": 0.3333, "always": 1.0}


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors of every model (a gate's quantile) and transition; a model without a transition gets the fallback values."""
    rows = None
    for name, share in MODELS.items():
        own = b.gated(spark, sf_dir, share).withColumn("asset", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    return ou.batch_priors(kept(rows))


def _batch_sql() -> str:
    parts, found = [], []
    for k, (name, share) in enumerate(MODELS.items()):
        # the chain of one model, all its names marked
        chain = b._gated(share).removeprefix(b.ROLLED + ", ") + q.RUNS.removeprefix(b.GATED) + q._pool("pb", 2) + q._vols("vb", True)
        for cte in ("sig", "g0", "gated", "moved", "runs", "heads", "seg", "sp", "sl", "speeds", "pbr", "pbx", "pb", "vbh", "vbn", "vbs", "vb"):
            chain = _marked(chain, cte, k)
        parts.append(chain)
        found.append(
            f"SELECT '{name}' AS model, t.source, t.dest, round(coalesce(CASE WHEN n_returns >= 5 AND slope > 0 AND slope < 1 AND -ln(slope) BETWEEN 0.01 AND 2.0 THEN -ln(slope) END, 0.35), 6) AS theta, round(coalesce(v.md, 0.70), 6) AS vol_ratio_median, coalesce(h.n, 0) AS n_segments, "
            f"(CASE WHEN n_returns >= 5 AND slope > 0 AND slope < 1 AND -ln(slope) BETWEEN 0.01 AND 2.0 THEN -ln(slope) END) IS NULL AS theta_fallback_used, v.md IS NULL AS vol_ratio_fallback_used, (SELECT count(DISTINCT regime) FROM gated_{k}) AS n_regimes "
            f"FROM (VALUES ('expansion', 'ranging'), ('ranging', 'expansion')) t(source, dest) LEFT JOIN pb_{k} p ON p.source = t.source AND p.dest = t.dest "
            f"LEFT JOIN (SELECT source, dest, median(vol_ratio) AS md FROM vb_{k} WHERE vol_ratio > 0.1 AND vol_ratio < 5.0 GROUP BY ALL) v ON v.source = t.source AND v.dest = t.dest LEFT JOIN (SELECT source, dest, count(*) AS n FROM heads_{k} GROUP BY ALL) h ON h.source = t.source AND h.dest = t.dest"
        )
    return f"{b.ROLLED}, {', '.join(parts)}, batch AS ({' UNION ALL '.join(found)})"


def _marked(sql: str, name: str, k: int) -> str:
    """``name`` as a relation, marked with k, wherever the SQL makes or reads it."""
    sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}_{k}", sql)
    return re.sub(rf"\b{name}( AS \(|\.)", rf"{name}_{k}\1", sql)


COLUMNS = "model source dest ~theta ~vol_ratio_median n_segments theta_fallback_used vol_ratio_fallback_used n_regimes"
b.plain("ou_priors_batch", _batch, COLUMNS, _batch_sql(), "batch")
register(
    "ou_fallback_summary",
    lambda s, d: ou.fallback_summary(_batch(s, d)),
    f"WITH {_batch_sql()} SELECT model, count(*) AS n_transitions, count(*) FILTER (theta_fallback_used) AS n_theta_fallbacks, count(*) FILTER (vol_ratio_fallback_used) AS n_vol_fallbacks, CAST(row_number() OVER (ORDER BY count(*) FILTER (theta_fallback_used) + count(*) FILTER (vol_ratio_fallback_used) DESC, model) AS INTEGER) AS worst FROM batch GROUP BY model",
)
