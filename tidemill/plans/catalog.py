"""Registry of the library's queries: name to builder, and name to the equivalent SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "bar_features"


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Add a query, and its SQL where SQL can express it."""
    QUERIES[name] = build
    if sql:
        ORACLE_SQL[name] = sql


for module in ("bar_queries", "strategy_queries", "run_queries", "kernel_queries"):
    importlib.import_module(f"tidemill.plans.{module}")
