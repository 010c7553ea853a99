"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def probe(sql: str | None = None):
    """Register a function of a table reader under its name, with SQL that gives the same rows."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = query
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
