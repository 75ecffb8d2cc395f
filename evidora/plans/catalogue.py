"""Registry of the engine's own queries: name to function, name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogue_documents, catalogue_extra, catalogue_more, catalogue_records, catalogue_search, catalogue_streams

FLAGSHIP = "hybrid_retrieve"
_PARTS = (catalogue_records, catalogue_search, catalogue_documents, catalogue_more, catalogue_extra, catalogue_streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for part in _PARTS for name, (function, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
