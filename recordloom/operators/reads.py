"""Whole answers: a record's page, a proceeding's coverage, a window's activity, their plain-data twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record_page(copies: DataFrame, record: str, order: list[Column], place: str) -> DataFrame:
    """One row a record: its headline copy's columns and the other places that it stands in."""
    nearest = F.row_number().over(Window.partitionBy(record).orderBy(*order))
    head = copies.withColumn("_k", nearest).where("_k = 1").drop("_k")
    places = copies.groupBy(record).agg(F.collect_set(place).alias("_all"))
    return head.join(places, record).withColumn("also_in", F.array_join(F.array_sort(F.array_remove("_all", F.col(place))), ", ")).drop("_all")


def twin(df: DataFrame, key: str) -> DataFrame:
    """Each row as JSON, nulls included, its fields in the order of their names."""
    own = [c for c in sorted(df.columns) if c != key]
    return df.select(key, F.to_json(F.struct(*own), {"ignoreNullFields": "false"}).alias("json"))


def dataset_card(counts: Column, first: Column, last: Column, name: Column) -> Column:
    """A dataset's card in JSON-LD."""
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Dataset").alias("@type"), name.alias("name"), F.concat_ws("/", first, last).alias("temporalCoverage"), counts.alias("size"))
    return F.to_json(body)


def walked_back(days: DataFrame, day: str) -> DataFrame:
    """How far back every day was asked, without a gap, from the last one."""
    n = days.select(day).distinct().withColumn("_back", F.row_number().over(Window.orderBy(F.desc(day))))  # a row for each day of the calendar
    last = n.agg(F.max(day).alias("_last"))
    kept = n.join(F.broadcast(last)).where(F.datediff("_last", day) == F.col("_back") - 1)
    return kept.agg(F.min(day).alias("walked_back_to"), F.count(F.lit(1)).alias("days"))


def verified(copy: DataFrame, held: DataFrame) -> DataFrame:
    """A backup against what is held, file by file ``(path, length, sha256)``: same, differs, missing or extra."""
    a, b = copy.select("path", F.struct("length", "sha256").alias("c")), held.select("path", F.struct("length", "sha256").alias("h"))
    verdict = F.when(F.col("c").isNull(), "missing").when(F.col("h").isNull(), "extra").when(F.col("c") == F.col("h"), "same").otherwise("differs")
    return a.join(b, "path", "full").select("path", verdict.alias("verdict"))
