"""Named queries over the star-schema tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query under ``name`` and its SQL twin, if any."""

    def add(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import case_queries, place_queries, record_queries, whole_queries  # noqa: F401  fill the registry

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _ORACLE


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinate confidence per region after repair, on the tables of ``sf_dir``."""
    return queries()["pair_confidence_by_region"](spark, sf_dir)
