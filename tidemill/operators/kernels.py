"""Kernels fitted in stages, as data: candidates are rows, the objective is an aggregate, and the fitted numbers are joined.

Each stage scores all candidates of all folds in one job: members of a fold meet its candidates, whose weights are arrays in
their rows, and the least squares of every (fold, candidate) come from centred moments.  The first stage takes a grid; each
later one moves one parameter at a time by a factor that shrinks to its root.  Ties go to the candidate listed first, scores
counting to nine digits, so that the outcome does not hang on the last bit.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.folds import ALPHA, DELTA
from tidemill.operators.regression import plane
from tidemill.operators.rolling import kernel_sums, power_law
from tidemill.scratch import drop, kept

PARAMETERS = ("alpha1", "delta1", "alpha2", "delta2")
BOUNDS = (ALPHA, DELTA, ALPHA, DELTA)


def grid(alphas: tuple[float, ...], deltas: tuple[float, ...]) -> list[tuple[float, ...]]:
    """All candidates of the first stage, in order."""
    return list(itertools.product(alphas, deltas, alphas, deltas))


def _weighed(candidates: DataFrame, n: int) -> DataFrame:
    return candidates.withColumns({"w1": power_law(F.col("alpha1"), F.col("delta1"), n), "w2": power_law(F.col("alpha2"), F.col("delta2"), n)})


def with_sums(rows: DataFrame, fitted: DataFrame, by: list[str], n: int) -> DataFrame:
    """``rows`` (with ``past``) under the parameters of their own group: ``r1`` and ``root_r2``, and all columns of ``fitted``."""
    r1, r2 = kernel_sums(F.col("w1"), F.col("w2"))
    return rows.join(_weighed(fitted, n), by).withColumns({"r1": r1, "root_r2": F.sqrt(r2)}).drop("w1", "w2")


def _best(rows: DataFrame, candidates: DataFrame, by: list[str], y: str, n: int) -> DataFrame:
    """The best candidate of each group, with its coefficients."""
    found = with_sums(rows, candidates, by, n)
    scored = plane(found, [*by, "candidate", *PARAMETERS], y, "r1", "root_r2")
    order = F.struct(F.round("in_r2", 9), -F.col("candidate"))
    names = [*PARAMETERS, "b0", "b1", "b2", "b1_sign", "in_r2"]
    return kept(scored.where("in_r2 is not null").groupBy(*by).agg(F.max_by(F.struct(*names), order).alias("_b")).select(*by, *[f"_b.{c}" for c in names]))


def _moved(best: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Nine candidates of each group: the best one, then each parameter less and more by the factor, within bounds."""
    moves = [F.struct(F.lit(0).alias("candidate"), *[F.col(p) for p in PARAMETERS])]
    for k, (name, (low, high)) in enumerate(zip(PARAMETERS, BOUNDS, strict=True)):
        for side, value in enumerate((F.col(name) / factor, F.col(name) * factor)):
            own = F.least(F.greatest(value, F.lit(low)), F.lit(high)).alias(name)
            moves.append(F.struct(F.lit(1 + 2 * k + side).alias("candidate"), *[own if p == name else F.col(p) for p in PARAMETERS]))
    return best.select(*by, F.explode(F.array(*moves)).alias("_m")).select(*by, "_m.*")


def fitted(rows: DataFrame, by: list[str], y: str, n: int, first: list[tuple[float, ...]], factors: tuple[float, ...]) -> DataFrame:
    """Parameters, coefficients and in-sample share explained of each group of ``rows`` (``past`` and ``y``), after all stages."""
    listed = F.array(*[F.struct(F.lit(i).alias("candidate"), *[F.lit(float(x)).alias(p) for p, x in zip(PARAMETERS, c, strict=True)]) for i, c in enumerate(first)])
    start = rows.select(*by).distinct().select(*by, F.explode(listed).alias("_m")).select(*by, "_m.*")
    best = _best(rows, start, by, y, n)
    for factor in factors:
        before, best = best, _best(rows, _moved(best, by, factor), by, y, n)
        drop(before)
    return best
