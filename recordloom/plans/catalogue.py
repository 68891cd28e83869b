"""The register that queries and their SQL are entered in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Enter a query under its function's name, with the SQL for the same rows if there is one."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"there is a query {f.__name__} already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small fixture for rules that the tables hold no rows for."""
    return spark.createDataFrame(rows, schema)
