"""Registry of named queries and their DuckDB oracle SQL.

Each plan module decorates ``fn(spark, sf_dir) -> DataFrame`` with
``@register(name, oracle=...)``.  ``oracle`` is ANSI SQL DuckDB runs over
the driver tables; ``None`` marks a query checked by row count only (its
exact check lives in ``tests/`` against a brute-force fixture).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def _load_all() -> None:
    # Importing the modules fills the registry.
    from textmill.plans import (  # noqa: F401
        chunk_plans,
        clean_plans,
        ingest_plans,
        log_plans,
        sandbox_plans,
        sql_plans,
        tree_plans,
        vector_plans,
    )


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
