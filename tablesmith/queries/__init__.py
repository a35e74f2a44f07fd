"""Registry of runnable queries over the driver's tables, each with its oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame``.  ``sql`` is DuckDB SQL over the
same tables (views named like the parquet files), or ``None`` for learners,
random operators and streams, which get a rows-only check.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}
_MODULES = ["sources", "clean", "profile", "prepare", "features", "selection",
            "learn", "forecast", "scoring", "gaps"]


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        assert name not in _QUERIES, f"duplicate query {name}"
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tablesmith.queries.q_{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
