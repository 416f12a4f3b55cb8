"""Queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives its rows from the same tables."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from mendloom.plans import job_queries, row_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    """Every query but those of the corpus operators."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of those queries that SQL can express."""
    _load()
    return dict(_SQL)
