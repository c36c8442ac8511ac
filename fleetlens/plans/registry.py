"""Registry of named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.views import Fleet, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Fleet``; ``sql`` names views as ``{view}``."""

    def register(build: Callable[[Fleet], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Fleet(spark, folder))

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_sql(sql)
        return build

    return register
