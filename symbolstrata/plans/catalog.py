"""All registered queries of the core, with the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import browse_queries, graph_queries, problems, profile_queries, quality_queries, question_queries, search_queries, source_queries

_MODULES = (problems, graph_queries, search_queries, profile_queries, quality_queries, source_queries, browse_queries, question_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for m in _MODULES for q in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
