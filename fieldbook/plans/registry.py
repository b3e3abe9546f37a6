"""All registered queries and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("presence_queries", "text_queries", "extract_queries", "archive_queries", "resolve_queries", "spatial_queries", "catalog_queries", "quality_queries", "source_queries", "stream_queries")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return register


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"fieldbook.plans.{m}")


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)
