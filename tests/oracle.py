"""Rows of a Spark query and of DuckDB in one comparable form."""

from __future__ import annotations

import os

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


def norm(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def spark_rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted("|".join(norm(r[c]) for c in columns) for r in df.collect())


def duck_rows(c, sql: str) -> tuple[list[str], list[str]]:
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    at = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted("|".join(norm(r[k]) for k in at) for r in result.fetchall())
