"""Queries of the library by the ids of its operator inventory."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, SQL, Query

MODULES = ("issues", "store", "code", "knowledge", "more")


def _load() -> None:
    for name in MODULES:
        import_module(f".{name}", __name__)


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
