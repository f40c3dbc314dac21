"""Query-key registry: each key maps to a Spark builder and (optionally) DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import functools

from tessera.plans.fixture_sql import with_fixtures
from tessera.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key``.

    ``sql`` is the DuckDB statement over the raw table views; fixtures it names
    are expanded to CTEs.  Keys without SQL get the driver's rows-only check.
    """
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)            # Python workers must be able to import tessera
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = with_fixtures(sql)
        return fn
    return deco
