"""Regressions over folds, as aggregates: AR(1) and two-factor least squares, forecasts and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.guards import ratio

RIDGE = 1e-10


def line(y: str, x: str) -> dict[str, Column]:
    """Intercept, slope and share of variance explained by one regressor."""
    return {"a0": F.regr_intercept(y, x), "a1": F.regr_slope(y, x), "in_r2": F.regr_r2(y, x)}


def plane(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Least squares of y on 1, x1, x2 for each group: centred moments, then a 2 x 2 solution in closed form."""
    c = F.col
    m = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("_y"), F.avg(x1).alias("_p"), F.avg(x2).alias("_q"), F.covar_pop(x1, x1).alias("_pp"), F.covar_pop(x2, x2).alias("_qq"),
        F.covar_pop(x1, x2).alias("_pq"), F.covar_pop(x1, y).alias("_py"), F.covar_pop(x2, y).alias("_qy"), F.covar_pop(y, y).alias("_yy"),
    )
    det = c("_pp") * c("_qq") - c("_pq") * c("_pq")
    m = m.withColumn("b1", ratio(c("_py") * c("_qq") - c("_qy") * c("_pq"), det)).withColumn("b2", ratio(c("_qy") * c("_pp") - c("_py") * c("_pq"), det))
    m = m.withColumn("b0", c("_y") - c("b1") * c("_p") - c("b2") * c("_q"))
    return m.select(*by, "n", "b0", "b1", "b2", ratio(c("b1") * c("_py") + c("b2") * c("_qy"), c("_yy")).alias("in_r2"), F.signum("b1").cast("int").alias("b1_sign"))


def errors(forecasts: DataFrame, by: list[str], truth: str, named: dict[str, str]) -> DataFrame:
    """Out-of-sample share explained (against the group's own mean) and mean squared error (x 1e6) of each forecast."""
    out = [F.count("*").alias("n_test")]
    total = F.regr_syy(truth, truth)
    for name, column in named.items():
        square = (F.col(truth) - F.col(column)) * (F.col(truth) - F.col(column))
        out += [F.coalesce(1 - ratio(F.sum(square), total), F.lit(0.0)).alias(f"oos_r2_{name}"), (F.avg(square) * 1e6).alias(f"mse_{name}")]
    return forecasts.groupBy(*by).agg(*out)


def shootout(folds: DataFrame, one: str, *others: str) -> DataFrame:
    """How forecasts compare over the folds: means, medians, and how often the first wins."""
    out = [F.count("*").alias("n_folds")]
    for name in (one, *others):
        out += [F.avg(f"oos_r2_{name}").alias(f"mean_{name}"), F.median(f"oos_r2_{name}").alias(f"median_{name}")]
    out += [F.avg((F.col(f"oos_r2_{one}") > F.col(f"oos_r2_{o}")).cast("double")).alias(f"wins_{o}") for o in others]
    return folds.agg(*out)
