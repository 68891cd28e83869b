"""Running sums and neighbours over a whole table's order, without one task that holds it.

Rows are dealt by ranges of the order and sorted; what a range needs of those before it (a
sum, a last row) is one row for each range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.storage import save


def ordered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` written in order, with ``range_part``, its range, and ``range_nth``, a number that grows along the order."""
    return save(df.orderBy(*order).select("*", F.spark_partition_id().alias("range_part"), F.monotonically_increasing_id().alias("range_nth")), "ordered")


def running_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to and including each."""
    placed = ordered(df.withColumn("range_value", value), order)
    sums = placed.groupBy("range_part").agg(F.sum("range_value").alias("s")).orderBy("range_part").collect()  # a row for each range
    before = [0, *accumulate(r["s"] or 0 for r in sums)][: len(sums)]
    spark, kind = df.sparkSession, placed.select(F.sum("range_value").alias("s")).schema["s"].dataType.simpleString()
    starts = spark.createDataFrame([(r["range_part"], b) for r, b in zip(sums, before)], f"range_of int, range_before {kind}")
    inside = F.sum("range_value").over(Window.partitionBy("range_part").orderBy("range_nth").rowsBetween(Window.unboundedPreceding, 0))
    return placed.join(F.broadcast(starts), F.col("range_part") == F.col("range_of")).withColumn(name, inside + F.col("range_before")).drop("range_value", "range_part", "range_nth", "range_of", "range_before")


def previous(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before each, null for the first."""
    placed = ordered(df, order)
    lasts = placed.groupBy("range_part").agg(F.max_by(value, "range_nth").alias("v")).orderBy("range_part").collect()  # a row for each range
    spark, kind = df.sparkSession, placed.schema[value].dataType.simpleString()
    carried = spark.createDataFrame([(b["range_part"], a["v"]) for a, b in zip(lasts, lasts[1:])], f"range_of int, range_carried {kind}")
    inside = Window.partitionBy("range_part").orderBy("range_nth")
    lagged = F.when(F.row_number().over(inside) == 1, F.col("range_carried")).otherwise(F.lag(value).over(inside))
    return placed.join(F.broadcast(carried), F.col("range_part") == F.col("range_of"), "left").withColumn(name, lagged).drop("range_part", "range_nth", "range_of", "range_carried")
