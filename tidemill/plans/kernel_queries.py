"""Registered queries on kernels that are fitted in stages, and the strategy run on their forecasts, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.guards import rounded
from tidemill.operators import kernels, regression, rolling, runs
from tidemill.plans import bar_queries as b
from tidemill.plans import run_queries as r
from tidemill.plans import strategy_queries as q
from tidemill.plans.bar_queries import N
from tidemill.plans.catalog import register
from tidemill.scratch import kept

#: First grid of exponents and shifts, and the factors of the later stages: 2, and its roots.
ALPHAS, DELTAS, FACTORS = (0.5, 1.0, 2.0), (1.0, 10.0), (2.0, 1.4142135623730951, 1.189207115002721)
FIRST = kernels.grid(ALPHAS, DELTAS)
BY = ["asset", "fold"]

# ---- the same steps in SQL -------------------------------------------------------------------------------------------


def _weights_sql(alpha: str, delta: str) -> str:
    raw = f"list_transform(range(1, {N + 1}), lambda l: (l + {delta}) ** (-{alpha}))"
    return f"list_transform({raw}, lambda x: x / list_sum({raw}))"


def _stage_sql(k: int, candidates: str) -> str:
    """One stage: sums under each candidate's weights, least squares by moments, and the best candidate of each fold."""
    dot = lambda a, w: f"coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {w}[i])), 0)"
    return f"""kc{k} AS MATERIALIZED ({candidates}), kw{k} AS MATERIALIZED (SELECT *, {_weights_sql('alpha1', 'delta1')} AS w1, {_weights_sql('alpha2', 'delta2')} AS w2 FROM kc{k}),
kx{k} AS (SELECT c.fold, c.candidate, n.rv_fwd AS y, {dot('n.past', 'c.w1')} AS p, sqrt(greatest({dot('n.past2', 'c.w2')}, 0)) AS q FROM kn n JOIN kw{k} c ON c.fold = n.fold WHERE n.part = 'train' AND n.place > {N}),
km{k} AS (SELECT fold, candidate, avg(y) AS y, avg(p) AS p, avg(q) AS q, covar_pop(p, p) AS pp, covar_pop(q, q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy, covar_pop(y, y) AS yy FROM kx{k} GROUP BY fold, candidate),
ks{k} AS (SELECT *, (py * qq - qy * pq) / nullif(pp * qq - pq * pq, 0) AS b1, (qy * pp - py * pq) / nullif(pp * qq - pq * pq, 0) AS b2 FROM km{k}), kr{k} AS (SELECT *, (b1 * py + b2 * qy) / nullif(yy, 0) AS in_r2 FROM ks{k}),
kb{k} AS MATERIALIZED (SELECT c.fold, alpha1, delta1, alpha2, delta2, s.y - b1 * p - b2 * q AS b0, b1, b2, in_r2, CAST(sign(b1) AS INTEGER) AS b1_sign FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(in_r2, 9) DESC, candidate) AS nr FROM kr{k} WHERE in_r2 IS NOT NULL) s JOIN kc{k} c ON c.fold = s.fold AND c.candidate = s.candidate WHERE nr = 1)"""


def _moved_sql(k: int, factor: float) -> str:
    rows = [f"SELECT fold, 0 AS candidate, alpha1, delta1, alpha2, delta2 FROM kb{k}"]
    for i, (name, (low, high)) in enumerate(zip(kernels.PARAMETERS, kernels.BOUNDS, strict=True)):
        for side, change in enumerate((f"{name} / {factor!r}", f"{name} * {factor!r}")):
            own = ", ".join(f"least(greatest({change}, {low!r}::DOUBLE), {high!r}::DOUBLE) AS {name}" if p == name else p for p in kernels.PARAMETERS)
            rows.append(f"SELECT fold, {1 + 2 * i + side}, {own} FROM kb{k}")
    return " UNION ALL ".join(rows)


_FIRST = ", ".join(f"({i}, {', '.join(f'{x!r}::DOUBLE' for x in c)})" for i, c in enumerate(FIRST))
_STAGES = [f"SELECT f.fold, v.* FROM (SELECT DISTINCT fold FROM kn) f, (VALUES {_FIRST}) v(candidate, alpha1, delta1, alpha2, delta2)"] + [_moved_sql(k, f) for k, f in enumerate(FACTORS)]
LAST = len(FACTORS)
PASTS = f"""kp AS MATERIALIZED (SELECT ts, coalesce(list_reverse(list(coalesce("return", 0)) OVER (ORDER BY i ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING)), []) AS past FROM bars),
kq AS MATERIALIZED (SELECT ts, past, list_transform(past, lambda x: x * x) AS past2 FROM kp)"""
FITTED = (
    PASTS
    + ", kn AS MATERIALIZED (SELECT m.*, a.fold, k.past, k.past2, row_number() OVER (PARTITION BY m.train_start, m.part ORDER BY m.ts) AS place FROM members m JOIN admitted a ON a.train_start = m.train_start JOIN kq k ON k.ts = m.ts), "
    + ", ".join(_stage_sql(k, c) for k, c in enumerate(_STAGES))
)


def _sums_sql(rows: str, fit: str, join: str, columns: str) -> str:
    """Rows with the sums under the weights of their fit."""
    dot = lambda a, w: f"coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {w}[i])), 0)"
    weighed = f"(SELECT *, {_weights_sql('alpha1', 'delta1')} AS w1, {_weights_sql('alpha2', 'delta2')} AS w2 FROM {fit})"
    return f"SELECT {columns}, {dot('x.past', 'c.w1')} AS r1, sqrt(greatest({dot('x.past2', 'c.w2')}, 0)) AS root_r2, c.b0, c.b1, c.b2, c.b1_sign FROM {rows} x JOIN {weighed} c ON {join}"


TESTED = (
    FITTED
    + f""", kt AS MATERIALIZED ({_sums_sql('kn', f'kb{LAST}', "c.fold = x.fold AND x.part = 'test'", 'x.fold, x.ts, x.close, x.rv_fwd, x.rv_trail')}),
kl AS (SELECT fold, regr_intercept(rv_fwd, rv_trail) AS a0, regr_slope(rv_fwd, rv_trail) AS a1 FROM kn WHERE part = 'train' AND place > {N} GROUP BY fold),
kf AS MATERIALIZED (SELECT kt.*, b0 + b1 * r1 + b2 * root_r2 AS sigma_pdv, a0 + a1 * rv_trail AS sigma_ar1 FROM kt JOIN kl USING (fold))"""
)


def _fitted_base() -> str:
    """The run's inputs under fitted kernels: ``dev`` before the holdout, ``hold`` under the last fold's own parameters."""
    folds = q.FOLDS.replace("rv_trail IS NOT NULL)", f"rv_trail IS NOT NULL AND ts < TIMESTAMP '{r.HOLDOUT}')")
    last = f"(SELECT * FROM kb{LAST} ORDER BY fold DESC LIMIT 1)"
    held = _sums_sql("(SELECT b.ts, b.close, k.past, k.past2 FROM bars b JOIN kq k ON k.ts = b.ts)", last, f"x.ts >= TIMESTAMP '{r.HOLDOUT}'", "x.ts, x.close")
    return (
        folds + ", " + TESTED
        + f""", dev AS MATERIALIZED (SELECT f.ts, f.close, round(greatest(sigma_pdv, 5e-4), 9) AS sigma_hat, round(r1, 12) AS r1, b1_sign AS beta1_sign FROM kf f JOIN (SELECT ts, min(fold) AS fold FROM kf GROUP BY ts) o ON o.ts = f.ts AND o.fold = f.fold),
hold AS MATERIALIZED (SELECT ts, close, round(greatest(b0 + b1 * r1 + b2 * root_r2, 5e-4), 9) AS sigma_hat, round(r1, 12) AS r1, b1_sign AS beta1_sign FROM ({held})), """
        + q.M1 + ", " + q._edge_sql().removeprefix(b.BARS + ", ")
    )


# ---- the same steps in Spark -----------------------------------------------------------------------------------------


def _pasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.lagged(b.rich(spark, sf_dir), N).select("asset", "ts", "close", "past")


def _rows(spark: SparkSession, sf_dir: str, **until: str) -> DataFrame:
    """Members of the admitted folds with their place in it and their past."""
    place = F.row_number().over(Window.partitionBy("asset", "train_start", "part").orderBy("ts"))
    members = kept(q._members(spark, sf_dir, **until).withColumn("place", place))
    folds = q.joins.admitted(q._folds(spark, sf_dir, **until), members, 500, 100).select("asset", "train_start", "fold")
    return kept(members.join(folds, ["asset", "train_start"]).join(_pasts(spark, sf_dir).drop("close"), ["asset", "ts"]))


def _fit(rows: DataFrame) -> DataFrame:
    return kernels.fitted(q._fit(rows), BY, "rv_fwd", N, FIRST, FACTORS)


def _forecasts(rows: DataFrame, fit: DataFrame) -> DataFrame:
    c = F.col
    test = kernels.with_sums(rows.where("part = 'test'"), fit, BY, N).join(q._ar1(rows).drop("in_r2"), BY)
    return test.withColumns({"sigma_pdv": c("b0") + c("b1") * c("r1") + c("b2") * c("root_r2"), "sigma_ar1": c("a0") + c("a1") * c("rv_trail"), "sigma_naive": c("rv_trail")})


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return regression.errors(_forecasts(rows, _fit(rows)), ["fold"], "rv_fwd", {"pdv": "sigma_pdv", "ar1": "sigma_ar1", "naive": "sigma_naive"})


b.plain("kernel_fit_staged", lambda s, d: _fit(_rows(s, d)), "fold ~alpha1 ~delta1 ~alpha2 ~delta2 ~b0 ~b1 ~b2 ~in_r2 b1_sign", f"{q.FOLDS}, {FITTED}", f"kb{LAST}", 5)
b.plain(
    "kernel_fit_staged_oos", _tested, "fold n_test ~oos_r2_pdv ~mse_pdv ~oos_r2_ar1 ~mse_ar1 ~oos_r2_naive ~mse_naive",
    f"{q.FOLDS}, {TESTED}, " + """ke AS (SELECT fold, count(*) AS n_test, 1 - sum((rv_fwd - sigma_pdv) ** 2) / regr_syy(rv_fwd, rv_fwd) AS oos_r2_pdv, avg((rv_fwd - sigma_pdv) ** 2) * 1e6 AS mse_pdv, 1 - sum((rv_fwd - sigma_ar1) ** 2) / regr_syy(rv_fwd, rv_fwd) AS oos_r2_ar1,
  avg((rv_fwd - sigma_ar1) ** 2) * 1e6 AS mse_ar1, 1 - sum((rv_fwd - rv_trail) ** 2) / regr_syy(rv_fwd, rv_fwd) AS oos_r2_naive, avg((rv_fwd - rv_trail) ** 2) * 1e6 AS mse_naive FROM kf GROUP BY fold)""", "ke", 5,
)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """As for the other runs, but on fitted kernels: holdout bars under the last fold's exponents, shifts and coefficients."""
    rows = _rows(spark, sf_dir, until=r.HOLDOUT)
    fit = _fit(rows)
    dev = kept(runs.predicted(_forecasts(rows, fit)))
    last = fit.groupBy("asset").agg(F.max_by(F.struct(*kernels.PARAMETERS, "fold", "b0", "b1", "b2"), "fold").alias("_p")).select("asset", "_p.*")
    held = kernels.with_sums(_pasts(spark, sf_dir).where(f"ts >= timestamp_ntz '{r.HOLDOUT}'"), last, ["asset"], N)
    hold = kept(runs.frozen(held.drop("fold", "b0", "b1", "b2", *kernels.PARAMETERS), last.select("asset", "fold", "b0", "b1", "b2")))
    return dev, hold, q._minutes(spark, sf_dir), kept(q._filled(spark, sf_dir).select("asset", "ts", "spread"))


def _fitted_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations before the holdout and the same two on it, all on fitted kernels."""
    dev, hold, minutes, spreads = _inputs(spark, sf_dir)
    own, late = r._features(dev), r._features(hold)
    edge = r.EDGE | {"spreads": spreads}
    named = {"median_edge_z0": (r._signals(own), edge | {"z_exit": 0.0}), "tilt_edge": (r._signals(own, True), edge | {"z_exit": None}), "holdout_z0": (r._signals(late), edge | {"z_exit": 0.0}), "holdout_tilt": (r._signals(late, True), edge | {"z_exit": None})}
    return rounded(runs.compared(named, minutes, 24).drop("asset"))


register(
    "run_fitted_strategy",
    _fitted_run,
    r._run_sql(
        [r._features_sql("m", "dev", 0.5), r._features_sql("h", "hold", 0.5), *(r._signals_sql(k, f, tilt) for k, f, tilt in (("m", "ffm", False), ("x", "ffm", True), ("h", "ffh", False), ("hx", "ffh", True)))],
        {"median_edge_z0": ("sigm", 0.0, True), "tilt_edge": ("sigx", None, True), "holdout_z0": ("sigh", 0.0, True), "holdout_tilt": ("sighx", None, True)},
        24, _fitted_base(),
    ),
)
