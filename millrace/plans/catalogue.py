"""Where queries and their SQL checks are registered."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
MODULES = ["scans", "syncing", "shaping", "cleaning", "joining", "counting", "documents", "functions",
           "sinking", "streams", "fitting", "flows", "apis"]

_QUERIES: dict[str, Query] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = fn
        if sql:
            _CHECKS[name] = sql
        return fn
    return register


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    for module in MODULES:
        importlib.import_module(f"millrace.plans.{module}")
    return dict(_QUERIES), dict(_CHECKS)


def middle(df: DataFrame, column: str) -> int:
    """Halfway between the smallest and the largest key: the bookmark an earlier run left."""
    low, high = df.selectExpr(f"min({column})", f"max({column})").first()
    return (low + high) // 2
