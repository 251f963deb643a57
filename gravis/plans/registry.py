"""Registry of named analyses: a Spark builder and, where SQL can state the
same result, an independent SQL text for DuckDB to check it against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def register(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``covers`` lists the inventory IDs the analysis exercises; ``sql`` is the
    oracle text (omitted for randomised or iterative analyses).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from gravis.session import ship_package
            ship_package(spark)  # workers of any session can import gravis
            return fn(spark, sf_dir)
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
