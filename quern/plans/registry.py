"""Where queries register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.session import parquet, plain_unions, small_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables below a folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        plain_unions(spark)
        small_batches(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return parquet(self.spark, self.folder, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``body(tables)`` as a query."""

    def put(body: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: body(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return body

    return put
