"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    for name in ("page_queries", "text_queries", "layout_queries", "streaming_queries", "document_queries", "image_queries", "frame_queries", "assembly_queries", "table_queries", "sheet_queries", "note_queries", "fidelity_queries", "picture_queries", "scan_queries", "meeting_queries", "judgement_queries"):
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
