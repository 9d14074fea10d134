"""Small column helpers shared by the registered corpus queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    """The spans of these kinds."""
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    """How many spans are of this kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
