"""Folding copies of a record to one row, and the order of sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headline(copies: DataFrame, record: list[str], order: list[Column]) -> DataFrame:
    """Of each record's copies the first in an order that has no ties."""
    nth = F.row_number().over(Window.partitionBy(*record).orderBy(*order))
    return copies.withColumn("_n", nth).where("_n = 1").drop("_n")


def with_also_in(copies: DataFrame, record: str, place: str, order: list[Column]) -> DataFrame:
    """Each record's nearest copy, and the other places it stands in, sorted and joined.

    The places are collected apart from the choice of the copy: both are of the record's own
    rows only.
    """
    near = headline(copies, [record], order)
    places = copies.groupBy(F.col(record).alias("_r")).agg(F.array_sort(F.collect_set(place)).alias("_all"))
    joined = near.join(places, F.col(record) == F.col("_r"))
    return joined.withColumn("also_in", F.array_join(F.array_remove("_all", F.col(place)), ",")).drop("_r", "_all")


def neighbours(df: DataFrame, within: list[str], order: list[Column], record: str) -> DataFrame:
    """Each record with the one before and the one after it on its sheet."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumns({"previous": F.lag(record).over(w), "following": F.lead(record).over(w)})


def top_in_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their number."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= k)


def round_robin(df: DataFrame, source: str, order: list[Column], limit: int) -> DataFrame:
    """A fair limit over several sources: first rows of each, then second rows, and so on."""
    nth = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn("nth", nth).orderBy("nth", source).limit(limit)
