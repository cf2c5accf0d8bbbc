"""Registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("retrieval", "curation", "analytics", "storage", "texts", "graphs", "people", "assist")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with SQL that DuckDB runs on the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")
