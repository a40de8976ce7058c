"""All queries of the engine's own operators, with their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_queries: dict[str, Callable] = {}
_oracles: dict[str, str] = {}
_modules = ("hashing", "metadata", "catalog", "provenance", "arrays", "histograms", "events", "store")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that DuckDB answers alike."""

    def add(f: Callable) -> Callable:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in _modules:
        importlib.import_module(f"{__package__}.{m}_queries")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
