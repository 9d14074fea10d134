"""Registered queries over folds, priors, spreads, events, trades and signatures, beside their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.guards import rounded
from tidemill.operators import backtest, bars, events, folds, joins, ou, regression, rolling, signatures, spread
from tidemill.operators.order import indexed
from tidemill.plans import bar_queries as b
from tidemill.plans.bar_queries import H, N, SCALES, plain
from tidemill.plans.catalog import register
from tidemill.scratch import kept, workdir
from tidemill.sources.ticks import ticks, write_signatures

TRAIN, TEST = "10 days", "2 days"

# ---- folds and baselines ---------------------------------------------------------------------------------------------


def _targets(spark: SparkSession, sf_dir: str, until: str = "9999-01-01") -> DataFrame:
    return b.rolled(spark, sf_dir).where(f"rv_fwd is not null and rv_trail is not null and ts < timestamp_ntz '{until}'")


def _folds(spark: SparkSession, sf_dir: str, **until: str) -> DataFrame:
    return joins.fold_table(_targets(spark, sf_dir, **until), TRAIN, TEST, 5 * H)


FOLDS = (
    b.ROLLED
    + """, tg AS (SELECT * FROM rolled WHERE rv_fwd IS NOT NULL AND rv_trail IS NOT NULL),
f0 AS (SELECT unnest(generate_series(min(ts) + INTERVAL '10 days', max(ts) - INTERVAL '2 days', INTERVAL '2 days')) AS test_start FROM tg),
folds AS (SELECT test_start - INTERVAL '10 days' AS train_start, test_start - INTERVAL '120 minutes' AS train_cutoff, test_start, test_start + INTERVAL '2 days' AS test_end FROM f0),
members AS (SELECT f.*, t.*, 'train' AS part FROM folds f JOIN tg t ON t.ts BETWEEN f.train_start AND f.train_cutoff UNION ALL SELECT f.*, t.*, 'test' AS part FROM folds f JOIN tg t ON t.ts BETWEEN f.test_start AND f.test_end),
sizes AS (SELECT train_start, train_cutoff, test_start, test_end, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test FROM members GROUP BY ALL),
admitted AS (SELECT *, row_number() OVER (ORDER BY train_start) - 1 AS fold FROM sizes WHERE n_train >= 500 AND n_test >= 100)"""
)
plain("fold_table", _folds, "train_start train_cutoff test_start test_end", FOLDS, "folds")
_members = lambda s, d, **until: joins.fold_rows(_targets(s, d, **until), _folds(s, d, **until))
_admitted = lambda s, d, **until: joins.admitted(_folds(s, d, **until), _members(s, d, **until), 500, 100)
plain("fold_membership", _admitted, "fold train_start test_start n_train n_test", FOLDS, "admitted")


def _numbered(spark: SparkSession, sf_dir: str, **until: str) -> DataFrame:
    """Members of the admitted folds, with their place among the training rows."""
    place = F.row_number().over(Window.partitionBy("asset", "train_start", "part").orderBy("ts"))
    rows = _members(spark, sf_dir, **until).withColumn("place", place)
    kernel = b._kernel(spark, sf_dir).select("asset", "ts", "r1", F.sqrt("r2").alias("root_r2"))
    return rows.join(_admitted(spark, sf_dir, **until).select("asset", "train_start", "fold"), ["asset", "train_start"]).join(kernel, ["asset", "ts"])


NUMBERED = (
    b._KERNEL + ", " + FOLDS.removeprefix(b.BARS + ", ")
    + """, num AS (SELECT m.*, a.fold, k.r1, sqrt(greatest(k.r2_ppm, 0) / 1e6) AS root_r2, row_number() OVER (PARTITION BY m.train_start, m.part ORDER BY m.ts) AS place FROM members m JOIN admitted a ON a.train_start = m.train_start JOIN kern k ON k.ts = m.ts),
ar1 AS (SELECT fold, regr_intercept(rv_fwd, rv_trail) * 1e3 AS a0_milli, regr_intercept(rv_fwd, rv_trail) AS a0, regr_slope(rv_fwd, rv_trail) AS a1, regr_r2(rv_fwd, rv_trail) AS in_r2 FROM num WHERE part = 'train' AND place > 50 GROUP BY fold),
mo AS (SELECT fold, count(*) AS n, avg(rv_fwd) AS y, avg(r1) AS p, avg(root_r2) AS q, covar_pop(r1, r1) AS pp, covar_pop(root_r2, root_r2) AS qq, covar_pop(r1, root_r2) AS pq, covar_pop(r1, rv_fwd) AS py, covar_pop(root_r2, rv_fwd) AS qy, covar_pop(rv_fwd, rv_fwd) AS yy FROM num WHERE part = 'train' AND place > 50 GROUP BY fold),
mb AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS b1, (qy * pp - py * pq) / (pp * qq - pq * pq) AS b2 FROM mo),
ols AS (SELECT fold, n, y - b1 * p - b2 * q AS b0, b1, b2, (b1 * py + b2 * qy) / yy AS in_r2, CAST(sign(b1) AS INTEGER) AS b1_sign FROM mb),
fc AS (SELECT num.*, a0 + a1 * rv_trail AS sigma_ar1, b0 + b1 * r1 + b2 * root_r2 AS sigma_pdv FROM num JOIN ar1 USING (fold) JOIN ols USING (fold) WHERE part = 'test'),
err AS (SELECT fold, count(*) AS n_test, 1 - sum((rv_fwd - sigma_pdv) ** 2) / regr_syy(rv_fwd, rv_fwd) AS oos_r2_pdv, avg((rv_fwd - sigma_pdv) ** 2) * 1e6 AS mse_pdv, 1 - sum((rv_fwd - sigma_ar1) ** 2) / regr_syy(rv_fwd, rv_fwd) AS oos_r2_ar1,
  avg((rv_fwd - sigma_ar1) ** 2) * 1e6 AS mse_ar1, 1 - sum((rv_fwd - rv_trail) ** 2) / regr_syy(rv_fwd, rv_fwd) AS oos_r2_naive, avg((rv_fwd - rv_trail) ** 2) * 1e6 AS mse_naive FROM fc GROUP BY fold)"""
)
_fit = lambda rows: rows.where(f"part = 'train' and place > {N}")


def _ar1(rows: DataFrame) -> DataFrame:
    return _fit(rows).groupBy("asset", "fold").agg(*[v.alias(k) for k, v in regression.line("rv_fwd", "rv_trail").items()])


def _ols(rows: DataFrame) -> DataFrame:
    return regression.plane(_fit(rows), ["asset", "fold"], "rv_fwd", "r1", "root_r2")


def _forecasts(spark: SparkSession, sf_dir: str, **until: str) -> DataFrame:
    rows = kept(_numbered(spark, sf_dir, **until))
    c = F.col
    lines, planes = _ar1(rows).drop("in_r2"), _ols(rows).select("asset", "fold", "b0", "b1", "b2")
    test = rows.where("part = 'test'").join(lines, ["asset", "fold"]).join(planes, ["asset", "fold"])
    return test.withColumns({"sigma_ar1": c("a0") + c("a1") * c("rv_trail"), "sigma_pdv": c("b0") + c("b1") * c("r1") + c("b2") * c("root_r2"), "sigma_naive": c("rv_trail")})


_errors = lambda s, d: regression.errors(_forecasts(s, d), ["fold"], "rv_fwd", {"pdv": "sigma_pdv", "ar1": "sigma_ar1", "naive": "sigma_naive"})
plain("ar1_baseline_folds", lambda s, d: _ar1(_numbered(s, d)).withColumn("a0_milli", F.col("a0") * 1e3), "fold ~a0_milli ~a1 ~in_r2", NUMBERED, "ar1", 5)
plain("ols_fixed_kernel_folds", lambda s, d: _ols(_numbered(s, d)), "fold n ~b0 ~b1 ~b2 ~in_r2 b1_sign", NUMBERED, "ols", 5)
plain("fold_oos_metrics", _errors, "fold n_test ~oos_r2_pdv ~mse_pdv ~oos_r2_ar1 ~mse_ar1 ~oos_r2_naive ~mse_naive", NUMBERED, "err", 5)
register(
    "baseline_shootout",
    lambda s, d: rounded(regression.shootout(_errors(s, d), "pdv", "ar1", "naive"), 5),
    f"WITH {NUMBERED} SELECT count(*) AS n_folds, " + ", ".join(f"round(avg(oos_r2_{k}), 5) AS mean_{k}, round(median(oos_r2_{k}), 5) AS median_{k}" for k in ("pdv", "ar1", "naive"))
    + ", " + ", ".join(f"round(avg(CAST(oos_r2_pdv > oos_r2_{k} AS DOUBLE)), 5) AS wins_{k}" for k in ("ar1", "naive")) + " FROM err",
)
plain(
    "dedupe_keep_first",
    lambda s, d: bars.distinct_first(_forecasts(s, d).select("asset", "ts", "fold", "sigma_ar1"), ["asset", "ts"], ["fold"]),
    "ts fold ~sigma_ar1", NUMBERED + ", dd AS (SELECT ts, min(fold) AS fold, arg_min(sigma_ar1, fold) AS sigma_ar1 FROM fc GROUP BY ts)", "dd", 9,
)
register(
    "split_train_oos",
    lambda s, d: joins.split_dates(b.bars_5m(s, d), "2024-01-03", "2024-01-10", "2024-01-09").groupBy("part").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first"), F.max("ts").alias("last")),
    f"WITH {b.B0} SELECT 'train' AS part, count(*) AS n_rows, min(ts) AS first, max(ts) AS last FROM b0 WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10' UNION ALL SELECT 'oos', count(*), min(ts), max(ts) FROM b0 WHERE ts >= TIMESTAMP '2024-01-09'",
)
register("pdv_walk_forward", lambda s, d: rounded(folds.walk_forward(b.rich(s, d), h=H, n=N, train=TRAIN, test=TEST, least=(450, 100)), 9))
register("sensitivity_grid", lambda s, d: rounded(folds.sensitivity(kept(b.rich(s, d)), (6, 12, 24), (25, 50, 100), (24, N), train=TRAIN, test="5 days", least=(450, 100))))

# ---- priors ----------------------------------------------------------------------------------------------------------

RUNS = (
    b.MOVED
    + """, runs AS (SELECT *, max(CASE WHEN is_transition OR i = 0 THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM moved),
heads AS (SELECT run, previous AS source, regime AS dest FROM runs WHERE is_transition),
seg AS (SELECT r.run, r.i, r.close, r.i - r.run AS k, h.source, h.dest FROM runs r JOIN heads h USING (run) WHERE r.i - r.run < 48),
sp AS (SELECT *, lag(close) OVER (PARTITION BY run ORDER BY k) AS x FROM seg),
sl AS (SELECT run, source, dest, count(*) AS n_prices, CASE WHEN regr_sxx(close, x) > 0 THEN regr_slope(close, x) END AS slope FROM sp GROUP BY ALL),
speeds AS (SELECT *, CASE WHEN n_prices >= 5 AND slope > 0 AND slope < 1 AND -ln(slope) BETWEEN 0.001 AND 5.0 THEN -ln(slope) END AS theta FROM (SELECT run, source, dest, n_prices, slope FROM sl WHERE slope IS NULL OR slope <= 0 OR slope > 0))"""
)


def _pool(name: str, least: int) -> str:
    return f""", {name}r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY run ORDER BY k)) AS r, count(*) OVER (PARTITION BY run) AS np FROM seg),
{name}x AS (SELECT *, lag(r) OVER (PARTITION BY source, dest ORDER BY run, k) AS x FROM {name}r WHERE np >= {least} AND r IS NOT NULL),
{name} AS (SELECT source, dest, count(*) AS n_returns, regr_slope(r, x) AS slope FROM {name}x GROUP BY ALL)"""


def _vols(name: str, own_run: bool) -> str:
    limit = "AND (r.i >= h.run OR r.run = h.prev_run)" if own_run else ""
    return f""", {name}h AS (SELECT run, source, dest, (SELECT max(q.run) FROM runs q WHERE q.i = heads.run - 1) AS prev_run FROM heads),
{name}n AS (SELECT h.run AS "at", h.source, h.dest, r.i >= h.run AS after, ln(r.close / lag(r.close) OVER (PARTITION BY h.run, r.i >= h.run ORDER BY r.i)) AS lr FROM {name}h h JOIN runs r ON r.i BETWEEN h.run - 30 AND h.run + 29 {limit}),
{name}s AS (SELECT "at", source, dest, stddev_samp(lr) FILTER (after) AS dest_vol, stddev_samp(lr) FILTER (NOT after) AS source_vol, count(*) FILTER (after) AS nd, count(*) FILTER (NOT after) AS ns FROM {name}n GROUP BY ALL),
{name} AS (SELECT "at", source, dest, CASE WHEN nd >= 3 AND ns >= 3 AND dest_vol > 1e-8 AND source_vol > 1e-8 AND dest_vol / source_vol BETWEEN 0.1 AND 5.0 THEN dest_vol / source_vol END AS vol_ratio FROM {name}s)"""


plain("ou_segments", lambda s, d: ou.segment_speeds(b.gated(s, d)), "run source dest n_prices ~theta", RUNS, "speeds", 5)
plain("ou_pooled_speed", lambda s, d: ou.pooled_speed(b.gated(s, d), 48, 4, 10), "source dest n_returns ~slope", RUNS + _pool("pa", 4), "pa")
plain("vol_ratio", lambda s, d: ou.volatility_ratios(b.gated(s, d)), "at source dest ~vol_ratio", RUNS + _vols("va", False), "va")
plain("vol_ratio_own_run", lambda s, d: ou.volatility_ratios(b.gated(s, d), own_run=True), "at source dest ~vol_ratio", RUNS + _vols("vb", True), "vb")
register(
    "ou_priors_regime",
    lambda s, d: ou.priors(b.gated(s, d)).drop("asset"),
    f"WITH {RUNS}{_pool('pa', 4)}{_vols('va', False)}, a AS (SELECT source, dest, median(theta) AS t, count(*) AS n, count(theta) AS nt FROM speeds GROUP BY ALL), v AS (SELECT source, dest, median(vol_ratio) AS r, count(vol_ratio) AS nr FROM va GROUP BY ALL), "
    "j AS (SELECT a.source, a.dest, coalesce(t, CASE WHEN n_returns >= 10 AND slope > 0 AND slope < 1 THEN -ln(slope) END, 0.20) AS tt, r, n, nt, nr FROM a LEFT JOIN pa ON pa.source = a.source AND pa.dest = a.dest LEFT JOIN v ON v.source = a.source AND v.dest = a.dest) "
    "SELECT source, dest, round_even(tt, 4) AS theta_median, round_even(0.6931471805599453 / tt, 2) AS half_life_median_bars, round_even(coalesce(r, 0.85), 4) AS vol_ratio_median, n AS n_transitions, nt AS n_valid_thetas, coalesce(nr, 0) AS n_valid_vol_ratios, nt = 0 AS fallback_used FROM j",
)
register(
    "ou_priors_pooled",
    lambda s, d: rounded(ou.pooled_priors(b.gated(s, d)).drop("asset")),
    f"WITH {RUNS}{_pool('pb', 2)}{_vols('vb', True)}, n AS (SELECT source, dest, count(*) AS n_segments FROM heads GROUP BY ALL), t AS (SELECT source, dest, CASE WHEN n_returns >= 5 AND slope > 0 AND slope < 1 AND -ln(slope) BETWEEN 0.01 AND 2.0 THEN -ln(slope) END AS th FROM pb), "
    "v AS (SELECT source, dest, median(vol_ratio) AS md, avg(vol_ratio) AS mn, stddev_pop(vol_ratio) AS sd, count(*) AS nv FROM vb WHERE vol_ratio > 0.1 AND vol_ratio < 5.0 GROUP BY ALL) "
    "SELECT n.source, n.dest, round(coalesce(th, 0.35), 6) AS theta, round(coalesce(md, 0.70), 6) AS vol_ratio_median, round(coalesce(mn, 0.70), 6) AS vol_ratio_mean, round(coalesce(sd, 0.0), 6) AS vol_ratio_std, n_segments, coalesce(nv, 0) AS n_vol_ratio_valid, th IS NULL AS theta_fallback_used, md IS NULL AS vol_ratio_fallback_used "
    "FROM n LEFT JOIN t ON t.source = n.source AND t.dest = n.dest LEFT JOIN v ON v.source = n.source AND v.dest = n.dest",
)

# ---- spreads ---------------------------------------------------------------------------------------------------------


def _edge_sql() -> str:
    """Rolling spread in two passes: deviations from the frame's own means, frame by frame."""
    return (
        b.BARS
        + """, e0 AS (SELECT ts, i, ln(open) AS o, ln(high) AS h, ln(low) AS l, ln(close) AS c, (ln(high) + ln(low)) / 2 AS m FROM bars),
e1 AS (SELECT *, lag(h) OVER (ORDER BY i) AS h1, lag(l) OVER (ORDER BY i) AS l1, lag(c) OVER (ORDER BY i) AS c1, lag(m) OVER (ORDER BY i) AS m1 FROM e0),
e2 AS (SELECT ts, i, m - o AS r1, o - m1 AS r2, m - c1 AS r3, c1 - m1 AS r4, o - c1 AS r5, CASE WHEN h <> l OR l <> c1 THEN 1.0 ELSE 0.0 END AS t, CASE WHEN o <> h THEN 1.0 ELSE 0 END + CASE WHEN o <> l THEN 1.0 ELSE 0 END AS po0, CASE WHEN c1 <> h1 THEN 1.0 ELSE 0 END + CASE WHEN c1 <> l1 THEN 1.0 ELSE 0 END AS pc0 FROM e1 WHERE c1 IS NOT NULL),
e3 AS (SELECT w.ts, w.i, avg(x.t) AS pt, count(*) AS n, avg(x.t * x.po0) AS po, avg(x.t * x.pc0) AS pc, avg(x.r1) AS a1, avg(x.r3) AS a3, avg(x.r5) AS a5 FROM e2 w JOIN e2 x ON x.i BETWEEN w.i - 46 AND w.i GROUP BY ALL),
e4 AS (SELECT w.ts, w.i, any_value(w.n) AS n, any_value(w.pt) AS pt, any_value(w.po) AS po, any_value(w.pc) AS pc, avg(-4 / w.po * (x.r1 - w.a1 / w.pt * x.t) * x.r2 - 4 / w.pc * (x.r3 - w.a3 / w.pt * x.t) * x.r4) AS q1, var_pop(-4 / w.po * (x.r1 - w.a1 / w.pt * x.t) * x.r2 - 4 / w.pc * (x.r3 - w.a3 / w.pt * x.t) * x.r4) AS v1,
  avg(-4 / w.po * (x.r1 - w.a1 / w.pt * x.t) * x.r5 - 4 / w.pc * (x.r5 - w.a5 / w.pt * x.t) * x.r4) AS q2, var_pop(-4 / w.po * (x.r1 - w.a1 / w.pt * x.t) * x.r5 - 4 / w.pc * (x.r5 - w.a5 / w.pt * x.t) * x.r4) AS v2 FROM e3 w JOIN e2 x ON x.i BETWEEN w.i - 46 AND w.i WHERE w.po > 0 AND w.pc > 0 AND w.n >= 47 AND w.pt * w.n >= 2 GROUP BY w.ts, w.i),
edge AS (SELECT b.ts, b.i, sqrt(abs((v2 * q1 + v1 * q2) / (v1 + v2))) AS spread, sqrt(abs((v2 * q1 + v1 * q2) / (v1 + v2))) * 1e4 AS spread_bps FROM bars b LEFT JOIN e4 USING (ts)),
filled AS (SELECT ts, least(greatest(coalesce(round(spread, 12), quantile_cont(round(spread, 12), 0.5) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 2e-5), 5e-5), 1e-3) AS spread FROM edge)"""
    )


def _edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.edge(b.rich(spark, sf_dir), 48)


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread.filled(_edge(spark, sf_dir).withColumn("spread", F.round("spread", 12)))


plain("edge_spread", lambda s, d: _edge(s, d).withColumn("spread_bps", F.col("spread") * 1e4), "ts ~spread_bps", _edge_sql(), "edge", 4)
plain("edge_spread_filled", lambda s, d: _filled(s, d).withColumn("spread_bps", F.col("spread") * 1e4), "ts ~spread_bps", _edge_sql() + ", fb AS (SELECT ts, spread * 1e4 AS spread_bps FROM filled)", "fb", 4)


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = bars.resample(ticks(spark, sf_dir), "1 minute").select("asset", "ts", "close")
    return joins.as_of(minutes, b.rolled(spark, sf_dir).select("asset", "ts", F.col("z_score").alias("z")), "z", default=-9.0)


M1 = "m0 AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close FROM ticks GROUP BY 1), m1 AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS m FROM m0)"
plain(
    "asof_join", _asof, "ts ~close ~z",
    b.ROLLED + f", {M1}, zs AS (SELECT ts, z_score AS z FROM rolled WHERE z_score IS NOT NULL), aj AS (SELECT m1.ts, close, coalesce(z, -9.0) AS z FROM m1 ASOF LEFT JOIN zs ON m1.ts >= zs.ts)", "aj",
)

# ---- events ----------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str, scales: list[events.Scale] = SCALES) -> DataFrame:
    return events.directional_changes(b.rich(spark, sf_dir), scales, events.Gaps("exclude"), ref=288, gap_minutes=20.0)


def _dc_sql(k: int, s: events.Scale, mode: str = "exclude") -> str:
    """Metrics and the scan of one scale, all names marked with ``k``; gap bars start anew, widen the threshold, or count as others."""
    restart = {"exclude": "false", "reset": "gap", "bridge": "gap AND leap > 0.10"}[mode]
    wide = "CASE WHEN gap THEN 1.5 ELSE 1.0 END" if mode == "bridge" else "1.0"
    w, first = s.window - 1, s.window + 288
    f = b._frame
    return f"""a{k} AS (SELECT ts, i, close, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY i)) > 20 * 60000000, false) AS gap FROM bars),
c{k} AS (SELECT *, CASE WHEN NOT gap THEN ln(close / lag(close) OVER (ORDER BY i)) END AS r, CASE WHEN NOT gap THEN close END AS p FROM a{k}), d{k} AS (SELECT *, abs(p - lag(p) OVER (ORDER BY i)) AS d1, abs(p - lag(p, 2) OVER (ORDER BY i)) AS d2 FROM c{k}),
e{k} AS (SELECT *, CASE WHEN count(r) OVER {f(f'{w} PRECEDING')} > {w} THEN stddev_samp(r) OVER {f(f'{w} PRECEDING')} END AS s, CASE WHEN count(d1) OVER {f(f'{w} PRECEDING')} > {w} THEN sum(d1) OVER {f(f'{w} PRECEDING')} END AS a1, CASE WHEN count(d2) OVER {f(f'{w} PRECEDING')} > {w} THEN sum(d2) OVER {f(f'{w} PRECEDING')} END AS a2 FROM d{k}),
h{k} AS (SELECT *, avg(s) OVER {f('287 PRECEDING')} AS sr, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN least(greatest(log2(greatest(a2 / (a1 + 1e-10), 1e-10)), 0.05), 0.95) ELSE 0.5 END AS hu FROM e{k}),
t{k} AS (SELECT ts, i, close, gap, coalesce(lag(hu) OVER (ORDER BY i), 0.5) AS hurst, coalesce(lag({s.theta} * coalesce(CASE WHEN sr > 0 THEN s / sr END, 1.0) * exp({s.aggression} * (0.5 - hu))) OVER (ORDER BY i), {s.theta}) * {wide} AS th, {restart} AS restart FROM (SELECT *, abs(close - lag(close) OVER (ORDER BY i)) / lag(close) OVER (ORDER BY i) AS leap FROM h{k})),
s{k} AS (SELECT i, CAST(NULL AS DOUBLE) AS anchor, close AS hi, i AS hx, close AS lo, i AS lx, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS at, CAST(NULL AS DOUBLE) AS lim FROM t{k} WHERE i = {first}
  UNION ALL SELECT n.i, n.anchor2, n.hi2, n.hx2, n.lo2, n.lx2, n.kind2, n.at2, n.th FROM (SELECT z.i, z.th, greatest(z.hi, z.close) AS hi2, CASE WHEN z.close > z.hi THEN z.i ELSE z.hx END AS hx2, least(z.lo, z.close) AS lo2, CASE WHEN z.close < z.lo THEN z.i ELSE z.lx END AS lx2,
    CASE WHEN z.anchor IS NULL THEN CASE WHEN (greatest(z.hi, z.close) - least(z.lo, z.close)) / least(z.lo, z.close) >= z.th THEN CASE WHEN (CASE WHEN z.close > z.hi THEN z.i ELSE z.hx END) > (CASE WHEN z.close < z.lo THEN z.i ELSE z.lx END) THEN 'upturn' ELSE 'downturn' END END WHEN z.close >= z.anchor * (1 + z.th) THEN 'upturn' WHEN z.close <= z.anchor * (1 - z.th) THEN 'downturn' END AS kind2,
    CASE WHEN z.anchor IS NULL AND (greatest(z.hi, z.close) - least(z.lo, z.close)) / least(z.lo, z.close) >= z.th THEN CASE WHEN (CASE WHEN z.close > z.hi THEN z.i ELSE z.hx END) > (CASE WHEN z.close < z.lo THEN z.i ELSE z.lx END) THEN greatest(z.hi, z.close) ELSE least(z.lo, z.close) END WHEN z.anchor IS NOT NULL AND (z.close >= z.anchor * (1 + z.th) OR z.close <= z.anchor * (1 - z.th)) THEN z.close ELSE z.anchor END AS anchor2,
    CASE WHEN z.anchor IS NULL THEN CASE WHEN (CASE WHEN z.close > z.hi THEN z.i ELSE z.hx END) > (CASE WHEN z.close < z.lo THEN z.i ELSE z.lx END) THEN (CASE WHEN z.close > z.hi THEN z.i ELSE z.hx END) ELSE (CASE WHEN z.close < z.lo THEN z.i ELSE z.lx END) END ELSE z.i END AS at2 FROM (SELECT q.i, q.close, q.th, CASE WHEN NOT q.restart THEN y.anchor END AS anchor, CASE WHEN q.restart THEN q.close ELSE y.hi END AS hi, CASE WHEN q.restart THEN q.i ELSE y.hx END AS hx, CASE WHEN q.restart THEN q.close ELSE y.lo END AS lo, CASE WHEN q.restart THEN q.i ELSE y.lx END AS lx FROM s{k} y JOIN t{k} q ON q.i = y.i + 1) z) n),
v{k} AS (SELECT '{s.name}' AS scale, t.ts, t.close AS price, z.kind AS type, z.lim AS theta_dynamic, t.hurst AS hurst_snapshot, g.gap AS is_gap_event FROM s{k} z JOIN t{k} t ON t.i = z.at JOIN t{k} g ON g.i = z.i WHERE z.kind IS NOT NULL)"""


def _all_dc_sql(mode: str = "exclude") -> str:
    return "RECURSIVE " + b.BARS + ", " + ", ".join(_dc_sql(k, s, mode) for k, s in enumerate(SCALES)) + ", dc AS (" + " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(len(SCALES))) + ")"


DC = _all_dc_sql()
_EVENT = "scale ts ~price type ~theta_dynamic ~hurst_snapshot is_gap_event"
plain("dc_events", _events, "scale ts ~price type ~theta_dynamic ~hurst_snapshot is_gap_event", DC, "dc", 7)
register("dc_event_counts", lambda s, d: events.counts(_events(s, d)), f"WITH {DC} SELECT scale, type, count(*) AS n_events, count(*) FILTER (is_gap_event) AS n_gap_events FROM dc GROUP BY ALL")
for _name, _mode in (("bridged", "bridge"), ("reset", "reset")):
    plain(f"dc_events_{_name}", lambda s, d, mode=_mode: events.directional_changes(b.rich(s, d), SCALES, events.Gaps(mode), gap_minutes=20.0), _EVENT, _all_dc_sql(_mode), "dc", 7)

# ---- trades ----------------------------------------------------------------------------------------------------------


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(b.signalled(spark, sf_dir).select("asset", "ts", "i", "signal", "sigma_hat", "z_score", "regime"))


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(indexed(bars.resample(ticks(spark, sf_dir), "1 minute"), out="m"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.candidates(_features(spark, sf_dir), _minutes(spark, sf_dir), flat=FLAT, h=H, z_exit=0.0)


FLAT = 0.05


def _cand_sql(k: str = "", z_exit: float | None = 0.0, edge: bool = False, signals: str = "signals", k1: float = 1.0) -> str:
    """Candidates of one configuration (names marked with ``k``), over ``signals``, ``m1`` and, for rolling spreads, ``filled``."""
    share = "coalesce(sp.spread, 1.5e-5)" if edge else "NULL::DOUBLE"
    spread = f"coalesce({share} * e.open, 0.05)"
    minutes = "SELECT m1.*, coalesce(filled.spread, 1.5e-5) * m1.close AS xs FROM m1 ASOF LEFT JOIN filled ON m1.ts >= filled.ts" if edge else "SELECT m1.*, 0.05 AS xs FROM m1"
    joined = "LEFT JOIN filled sp ON sp.ts = s.ts" if edge else ""
    revert = f"WHEN x.z * signal >= {z_exit} THEN 'z_revert'" if z_exit is not None else ""
    own = "signal_time, entry_time, bar, signal, entry_price, stop_price, target_price, z_score_entry, regime, spread_usd"
    return f"""mz{k} AS (SELECT y.*, round(s.z_score, 6) AS z FROM ({minutes}) y LEFT JOIN {signals} s ON s.ts = y.ts),
g0s{k} AS (SELECT s.ts AS signal_time, s.ts + INTERVAL '5 minutes' AS entry_time, s.i AS bar, s.signal, greatest(s.sigma_hat, 5e-4) AS sg, round(s.z_score, 6) AS z_score_entry, s.regime, e.m AS em, {spread} AS spread_usd, e.open + s.signal * 0.5 * {spread} AS entry_price FROM {signals} s JOIN m1 e ON e.ts = s.ts + INTERVAL '5 minutes' {joined} WHERE s.signal <> 0),
g1s{k} AS (SELECT *, CASE WHEN {k1} * sg * entry_price < 2 * spread_usd THEN 2 * spread_usd / {k1} ELSE sg * entry_price END AS dp FROM g0s{k}),
g2s{k} AS (SELECT *, entry_price - signal * {k1} * dp AS stop_price, entry_price + signal * dp AS target_price FROM g1s{k}),
nr{k} AS (SELECT g.*, x.m, x.ts AS t, x.close AS xc, x.xs, CASE WHEN (signal = 1 AND x.low <= stop_price) OR (signal = -1 AND x.high >= stop_price) THEN 'stop_loss' WHEN (signal = 1 AND x.high >= target_price) OR (signal = -1 AND x.low <= target_price) THEN 'take_profit'
  WHEN x.ts >= signal_time + INTERVAL '120 minutes' THEN 'time_stop' {revert} END AS reason FROM g2s{k} g JOIN mz{k} x ON x.m > g.em AND x.m <= g.em + 130),
ends{k} AS (SELECT {own}, coalesce(arg_min(t, m) FILTER (reason IS NOT NULL), arg_max(t, m)) AS exit_time, coalesce(arg_min(reason, m) FILTER (reason IS NOT NULL), 'end_of_data') AS exit_reason, coalesce(arg_min(xc, m) FILTER (reason IS NOT NULL), arg_max(xc, m)) AS xc, coalesce(arg_min(xs, m) FILTER (reason IS NOT NULL), arg_max(xs, m)) AS xs FROM nr{k} GROUP BY ALL
  UNION ALL SELECT {own}, entry_time, 'end_of_data', (SELECT close FROM mz{k} q WHERE q.m = g.em), (SELECT xs FROM mz{k} q WHERE q.m = g.em) FROM g2s{k} g WHERE em = (SELECT max(m) FROM m1)),
cand{k} AS (SELECT * REPLACE (CASE WHEN exit_reason = 'end_of_data' THEN xs ELSE spread_usd END AS spread_usd), CASE WHEN signal = 1 THEN 'LONG' ELSE 'SHORT' END AS side, CASE exit_reason WHEN 'stop_loss' THEN stop_price WHEN 'take_profit' THEN target_price ELSE xc END - signal * 0.5 * xs AS exit_price, (epoch_us(exit_time) - epoch_us(entry_time)) / 60e6 AS duration_min, row_number() OVER (ORDER BY signal_time) AS seq FROM ends{k}),
cp{k} AS (SELECT *, signal * (exit_price - entry_price) AS pnl_usd, signal * (exit_price - entry_price) / entry_price AS return_pct FROM cand{k})"""


def _trades_sql(k: str = "") -> str:
    return f"""acc{k} AS (SELECT 1::BIGINT AS seq FROM cp{k} WHERE seq = 1 UNION ALL SELECT nx.seq FROM (SELECT (SELECT min(q.seq) FROM cp{k} q WHERE q.signal_time >= p.exit_time AND q.entry_time > p.exit_time AND q.bar - p.bar >= 24) AS seq FROM acc{k} a JOIN cp{k} p ON p.seq = a.seq) nx WHERE nx.seq IS NOT NULL),
trades{k} AS (SELECT cp{k}.* FROM cp{k} JOIN acc{k} USING (seq)),
d0{k} AS (SELECT signal_time, sum(pnl_usd) OVER (ORDER BY signal_time ROWS UNBOUNDED PRECEDING) AS cum_pnl FROM trades{k}), dw{k} AS (SELECT *, max(cum_pnl) OVER (ORDER BY signal_time ROWS UNBOUNDED PRECEDING) AS peak, cum_pnl - max(cum_pnl) OVER (ORDER BY signal_time ROWS UNBOUNDED PRECEDING) AS drawdown FROM d0{k}),
dl{k} AS (SELECT CAST(exit_time AS DATE) AS exit_date, sum(pnl_usd) AS pnl_usd, count(*) AS n_trades FROM trades{k} GROUP BY 1)"""


def _metrics_sql(k: str = "") -> str:
    return (
        "count(*) AS total_trades, round(avg(CAST(pnl_usd > 0 AS DOUBLE)), 6) AS win_rate, round(sum(pnl_usd), 6) AS total_pnl_usd, round(sum(pnl_usd) FILTER (pnl_usd > 0) / abs(sum(pnl_usd) FILTER (pnl_usd <= 0)), 6) AS profit_factor, "
        f"round(avg(duration_min), 6) AS mean_duration_min, round(avg(spread_usd), 6) AS avg_spread_usd, round((SELECT min(drawdown) FROM dw{k}), 6) AS max_drawdown_usd, round((SELECT coalesce(avg(pnl_usd) / nullif(stddev_samp(pnl_usd), 0) * sqrt(252.0), 0) FROM dl{k}), 6) AS daily_sharpe FROM trades{k} HAVING count(*) > 0"
    )


CAND = f"{b.SIGNALS}, {M1}, {_cand_sql()}"
TRADES = f"RECURSIVE {CAND}, {_trades_sql()}"
_trades = lambda s, d: kept(backtest.accepted(kept(_candidates(s, d)), 24))
_TRADE = "signal_time entry_time exit_time side ~entry_price ~exit_price ~stop_price ~target_price ~pnl_usd exit_reason ~duration_min ~z_score_entry regime ~spread_usd"
plain("bt_candidates", _candidates, _TRADE, CAND, "cp")
plain("bt_trades", _trades, _TRADE, TRADES, "trades")
plain("bt_daily_pnl", lambda s, d: backtest.daily(_trades(s, d)), "exit_date ~pnl_usd n_trades", TRADES, "dl")
plain("bt_drawdown", lambda s, d: backtest.drawdown(_trades(s, d)), "signal_time ~cum_pnl ~peak ~drawdown", TRADES, "dw")
register("bt_exit_reasons", lambda s, d: backtest.exit_reasons(_trades(s, d)).drop("asset"), f"WITH {TRADES} SELECT exit_reason, count(*) AS n_trades FROM trades GROUP BY 1")
register("bt_metrics", lambda s, d: rounded(backtest.metrics(_trades(s, d)).drop("asset")), f"WITH {TRADES} SELECT {_metrics_sql()}")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of several configurations at once: flat and rolling spreads, with and without the z exit."""
    features, minutes = _features(spark, sf_dir), _minutes(spark, sf_dir)
    spreads = kept(_filled(spark, sf_dir).select("asset", "ts", "spread"))
    options = {"flat": {"z_exit": 0.0}, "flat_no_z": {"z_exit": None}, "edge": {"z_exit": 0.0, "spreads": spreads}}
    runs = backtest.configurations({name: backtest.candidates(features, minutes, flat=FLAT, h=H, **own) for name, own in options.items()})
    by = ("config", "asset")
    trades = kept(backtest.accepted(kept(reduce(DataFrame.unionByName, runs)), 24, by))
    return rounded(backtest.metrics(trades, by).drop("asset"))


_RUNS: dict[str, tuple] = {"flat": ("a", 0.0, False), "flat_no_z": ("b", None, False), "edge": ("c", 0.0, True)}
register(
    "bt_config_matrix",
    _matrix,
    f"WITH RECURSIVE {b.SIGNALS}, {M1}, " + _edge_sql().removeprefix(b.BARS + ", ") + ", " + ", ".join(f"{_cand_sql(*own)}, {_trades_sql(own[0])}" for own in _RUNS.values())
    + " " + " UNION ALL ".join(f"SELECT '{name}' AS config, {_metrics_sql(own[0])}" for name, own in _RUNS.items()),
)

# ---- signatures ------------------------------------------------------------------------------------------------------

L = 10


def _per_scale(value: str) -> Column:
    """A parameter of each row's own scale."""
    return F.coalesce(*[F.when(F.col("scale") == x.name, F.lit(getattr(x, value))) for x in SCALES])


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).withColumn("_k", F.concat_ws("|", "asset", "scale"))
    placed = indexed(own, "_k", ("ts",)).drop("_k")
    return kept(signatures.state_channels(placed, theta=_per_scale("theta"), aggression=_per_scale("aggression")))


_windows = lambda s, d: signatures.windows(_states(s, d), L)
_OWN = {v: "CASE scale " + " ".join(f"WHEN '{x.name}' THEN {getattr(x, v)}" for x in SCALES) + " END" for v in ("theta", "aggression")}
STATES = (
    DC
    + f""", ev AS (SELECT *, row_number() OVER (PARTITION BY scale ORDER BY ts) - 1 AS i FROM dc),
st AS (SELECT scale, i, ts, price, theta_dynamic, hurst_snapshot, CAST(CAST(ln(price + 1e-10) - first_value(ln(price + 1e-10)) OVER (PARTITION BY scale ORDER BY i) AS FLOAT) AS DOUBLE) AS p, CAST(CAST(theta_dynamic / ({_OWN['theta']} * exp({_OWN['aggression']} * (0.5 - hurst_snapshot)) + 1e-10) AS FLOAT) AS DOUBLE) AS sigma, CAST(CAST(hurst_snapshot AS FLOAT) AS DOUBLE) AS h,
  CAST(CAST(ln(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY scale ORDER BY i))) / 1e6, 1.0) + 1e-6) AS FLOAT) AS DOUBLE) AS u FROM ev)"""
)


def _cut_sql(n: int, k: str = "") -> str:
    """Windows of ``n`` events, scaled points and lead-lag paths (names marked with ``k``)."""
    scaled = ", ".join(f"(x.{c} - min(x.{c}) OVER v) / (max(x.{c}) OVER v - min(x.{c}) OVER v + 1e-8) AS {c}" for c in signatures.CHANNELS)
    path = ", ".join([f"a.{c} AS lag_{c}" for c in signatures.CHANNELS] + [f"z.{c} AS lead_{c}" for c in signatures.CHANNELS])
    return f"""wi{k} AS (SELECT scale, i AS start_idx, last_value(i) OVER w AS end_idx, ts AS start_ts, last_value(ts) OVER w AS end_ts, price AS start_price, last_value(price) OVER w AS end_price, avg(hurst_snapshot) OVER w AS mean_hurst, avg(theta_dynamic) OVER w AS mean_theta_dynamic, count(*) OVER w AS n FROM st WINDOW w AS (PARTITION BY scale ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
mw{k} AS (SELECT a.scale, a.start_idx, CAST(x.i - a.start_idx AS INTEGER) AS k, {scaled} FROM wi{k} a JOIN st x ON x.scale = a.scale AND x.i BETWEEN a.start_idx AND a.end_idx WHERE a.n = {n} WINDOW v AS (PARTITION BY a.scale, a.start_idx)),
ll{k} AS (SELECT a.scale, a.start_idx, CAST(g.k AS INTEGER) AS k, {path} FROM range(0, {2 * n - 1}) g(k) JOIN mw{k} a ON a.k = g.k // 2 JOIN mw{k} z ON z.scale = a.scale AND z.start_idx = a.start_idx AND z.k = (g.k + 1) // 2)"""


WINDOWS = STATES + ", " + _cut_sql(L)
plain("state_channels", lambda s, d: _states(s, d).withColumns({c: F.col(c).cast("double") for c in signatures.CHANNELS}), "scale i ts ~p ~sigma ~h ~u", STATES, "st", 5)
plain("window_metadata", _windows, "scale start_idx end_idx start_ts end_ts ~start_price ~end_price ~mean_hurst ~mean_theta_dynamic", WINDOWS, "wi WHERE n = 10", 7)


def _long(df: DataFrame, points: str, names: list[str]) -> DataFrame:
    """Windows as rows, one a point: its place and channels, rounded."""
    each = df.select("scale", "start_idx", F.posexplode(points).alias("k", "x"))
    return rounded(each.select("scale", "start_idx", "k", *[F.element_at("x", j + 1).cast("double").alias(c) for j, c in enumerate(names)]), 4)


_scaled = lambda s, d: signatures.min_max(_windows(s, d))
_PATH = [f"{side}_{c}" for side in ("lag", "lead") for c in signatures.CHANNELS]
_points = lambda: F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda k: F.array(*[F.element_at(F.col(c), k + 1) for c in signatures.CHANNELS])).alias("points")
register("minmax_windows", lambda s, d: _long(_scaled(s, d).select("scale", "start_idx", _points()), "points", list(signatures.CHANNELS)), f"WITH {WINDOWS} SELECT scale, start_idx, k, " + ", ".join(f"round({c}, 4) AS {c}" for c in signatures.CHANNELS) + " FROM mw")
register("lead_lag", lambda s, d: _long(signatures.lead_lag(_scaled(s, d)), "path", _PATH), f"WITH {WINDOWS} SELECT scale, start_idx, k, " + ", ".join(f"round({c}, 4) AS {c}" for c in _PATH) + " FROM ll")


def _name(word: tuple[int, ...]) -> str:
    return "w" + "".join(str(c + 1) for c in word)


def _words(found: DataFrame, depth: int, *columns: str) -> DataFrame:
    """The signature's numbers as columns, named by their words."""
    return rounded(found.select(*columns, *[F.element_at("signature", j + 1).alias(_name(w)) for j, w in enumerate(signatures.lyndon(8, depth))]), 4)


def _words_sql(depth: int, k: str = "") -> str:
    """Log-signatures to depth 2 or 3 by sums over the points of each path, from ``ll``: ``lg`` (names marked with ``k``)."""
    words = signatures.lyndon(8, depth)
    pairs = [(x, y) for x in range(8) for y in range(8)] if depth > 2 else [w for w in words if len(w) == 2]
    first = ", ".join(f"{c} - first_value({c}) OVER o AS f{x}, coalesce(lead({c}) OVER o - {c}, 0) AS d{x}" for x, c in enumerate(_PATH))
    parts = [f"sum(f{x} * d{y} + 0.5 * d{x} * d{y}) OVER o - (f{x} * d{y} + 0.5 * d{x} * d{y}) AS q{x}{y}" for x, y in pairs]
    sums = [f"sum(d{x}) AS t{x}" for x in range(8)] + [f"sum(f{x} * d{y} + 0.5 * d{x} * d{y}) AS t{x}{y}" for x, y in pairs]
    sums += [f"sum(q{w[0]}{w[1]} * d{w[2]} + 0.5 * f{w[0]} * d{w[1]} * d{w[2]} + d{w[0]} * d{w[1]} * d{w[2]} / 6) AS t{w[0]}{w[1]}{w[2]}" for w in words if len(w) == 3]

    def word(w: tuple[int, ...]) -> str:
        name = "t" + "".join(map(str, w))
        if len(w) == 2:
            return f"{name} - 0.5 * t{w[0]} * t{w[1]}"
        return name if len(w) == 1 else f"{name} - 0.5 * (t{w[0]} * t{w[1]}{w[2]} + t{w[0]}{w[1]} * t{w[2]}) + t{w[0]} * t{w[1]} * t{w[2]} / 3"

    order = "(PARTITION BY scale, start_idx ORDER BY k)"
    return f"""li{k} AS (SELECT scale, start_idx, k, {first} FROM ll{k} WINDOW o AS {order}), lq{k} AS (SELECT *, {', '.join(parts)} FROM li{k} WINDOW o AS (PARTITION BY scale, start_idx ORDER BY k ROWS UNBOUNDED PRECEDING)),
ls{k} AS (SELECT scale, start_idx, {', '.join(sums)} FROM lq{k} GROUP BY scale, start_idx), lg{k} AS (SELECT scale, start_idx, {', '.join(f'round({word(w)}, 4) + 0.0 AS {_name(w)}' for w in words)} FROM ls{k})"""


register("logsig_depth2", lambda s, d: rounded(signatures.level_two(signatures.lead_lag(_scaled(s, d))).drop("asset"), 4), f"WITH {WINDOWS}, {_words_sql(2)} SELECT * FROM lg")
register("logsig_depth3", lambda s, d: _words(signatures.signature_windows(_states(s, d), (L,), 3), 3, "scale", "start_idx"), f"WITH {WINDOWS}, {_words_sql(3)} SELECT * FROM lg")


def _depth4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word's number, a row a window and word."""
    each = signatures.log_signatures(_states(spark, sf_dir), L, 4).select("scale", "start_idx", F.posexplode("signature").alias("word", "x"))
    return each.withColumn("x", F.round(F.col("x").cast("double"), 4))


register("logsig_depth4", _depth4)
#: The lengths that are swept, and the two spans of the split: they may overlap or leave a gap.
SWEPT, SPANS = (10, 15, 17, 20, 27, 50), ("2024-01-03", "2024-01-18", "2024-01-16")


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of windows of several lengths over all scales, written in files of bounded size, read back and split by their last event's time."""
    found = signatures.signature_windows(_states(spark, sf_dir), SWEPT, 2)
    back = write_signatures(found, f"{workdir(spark).rstrip('/')}/tidemill-{uuid.uuid4().hex}")
    split = joins.split_dates(back.withColumnRenamed("end_ts", "end_timestamp"), *SPANS)
    return _words(split, 2, "length", "part", "scale", "start_idx", F.col("end_timestamp").alias("end_ts"))


def _spans_sql(n: int) -> str:
    own = f"SELECT {n} AS length, '%s' AS part, w.scale, w.start_idx, w.end_ts, g.* EXCLUDE (scale, start_idx) FROM wi{n} w JOIN lg{n} g ON g.scale = w.scale AND g.start_idx = w.start_idx WHERE w.n = {n} AND w.end_ts"
    train, oos = own % "train", own % "oos"
    return f"{train} BETWEEN TIMESTAMP '{SPANS[0]}' AND TIMESTAMP '{SPANS[1]}' UNION ALL {oos} >= TIMESTAMP '{SPANS[2]}'"


register("signature_sweep", _sweep, f"WITH {STATES}, " + ", ".join(f"{_cut_sql(n, str(n))}, {_words_sql(2, str(n))}" for n in SWEPT) + " " + " UNION ALL ".join(_spans_sql(n) for n in SWEPT))
