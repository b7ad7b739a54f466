"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the inventory's id, with its SQL over the driver's tables."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            # a filtered count is a 64-bit number as in Spark; DuckDB's count_if is a 128-bit one
            SQL[name] = sql.replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return register
