"""All queries over the driver tables, by name, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("scans", "joins", "aggregates", "ordered", "scalars", "graphs", "metrics", "features", "corpus", "simulations", "learning", "ingestion", "scenarios", "optimise", "records", "decisions", "served")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(f: Query) -> Query:
        _FOUND[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"ripplenet.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
