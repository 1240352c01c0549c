"""Named queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spreadloom.sources.panels import with_panels

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, grain: str = "week", recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql may use the panels."""

    def put(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = with_panels(sql, grain, recursive)
        return query

    return put
