"""All queries over the search operators, with their SQL oracles.

Each entry of QUERIES runs an operator over whole tables, or over the literal rows
below where the tables hold nothing of the kind (identifiers, paths, provider
records). The oracles compute the same from the same tables or rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_rank, queries_search, queries_sessions

MODULES = (queries_search, queries_rank, queries_sessions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
