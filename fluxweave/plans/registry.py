"""Named queries with the operators they cover and, where SQL can express them, a DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
