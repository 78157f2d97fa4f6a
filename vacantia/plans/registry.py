"""The registered queries and their DuckDB check texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.plans.fixtures import oracle

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(key: str, check: str | None = None):
    """Register a query; ``check`` is its DuckDB text (fixture tokens allowed)."""

    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder.rstrip("/"))

        run.__doc__, run.__name__ = fn.__doc__, key
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if check is not None:
            ORACLES[key] = oracle(check)
        return fn

    return register
