"""Column helpers that keep missing values NULL: no NaN and no infinity ever enters a plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln(x: Column) -> Column:
    """Natural logarithm, NULL unless x > 0."""
    return F.when(x > 0, F.log(x))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def root(x: Column) -> Column:
    """Square root of x, of 0 where x is negative."""
    return F.sqrt(floor_at(x, 0.0))


def floor_at(x: Column, least: float) -> Column:
    """The greater of x and ``least``, NULL where x is."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def clipped(x: Column, least: float, most: float) -> Column:
    """x within bounds, NULL where x is."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(least)), F.lit(most)))


def full(value: Column, counted: Column, window, rows: int) -> Column:
    """A windowed value, NULL unless ``rows`` values of ``counted`` stand in its frame."""
    return F.when(F.count(counted).over(window) >= rows, value.over(window))


def rounded(df, digits: int = 6, **own: int):
    """All DOUBLE columns rounded, those named in ``own`` to their own digits."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, own.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
