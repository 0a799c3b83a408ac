"""Query catalogue: key -> Spark builder (spark, sf_dir) -> DataFrame, plus its
DuckDB oracle SQL when the query is SQL-expressible."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query builder under ``key`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import search, stats, relate, textq, textindex, maintain, threadq, partq, people, io, headers  # noqa: F401
