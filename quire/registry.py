"""The registered queries of the engine's own operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` gives the same rows in DuckDB."""

    def add(function):
        _queries[name] = function
        if sql is not None:
            _oracles[name] = sql
        return function

    return add


def _load() -> None:
    from quire.plans import documents, page_layout, queries  # noqa: F401  registers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
