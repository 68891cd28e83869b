"""Integrity rules as queries that return what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_live(df: DataFrame, key: list[str], live: Column) -> DataFrame:
    """Keys with more than one live row."""
    return df.where(live).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def together(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which some but not all of the columns are set."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.where((n > 0) & (n < len(columns)))


def orphans(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference leads nowhere (a null one is no reference)."""
    return df.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias("_k")).distinct(), F.col(column) == F.col("_k"), "left_anti")


def human_superseded(df: DataFrame, row_id: str, is_human: str) -> DataFrame:
    """Human rows that a row of a model replaced."""
    later = df.select(F.col(row_id).alias("_id"), F.col(is_human).alias("_h"))
    return df.where(F.col(is_human) & F.col("superseded_by").isNotNull()).join(later, F.col("superseded_by") == F.col("_id")).where(~F.col("_h")).drop("_id", "_h")


def backward(df: DataFrame, row_id: str) -> DataFrame:
    """Rows replaced by an earlier row (a row may point to itself: retired without successor)."""
    return df.where(F.col("superseded_by") < F.col(row_id))


def impossible_dates(df: DataFrame, column: str) -> DataFrame:
    """Strings that are shaped like a date and aren't one."""
    return df.where(F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col(column), "yyyy-MM-dd").isNull())


def wrong_spans(df: DataFrame, text: str, start: str, end: str, raw: str) -> DataFrame:
    """Spans that don't hold what they quote, white space aside."""
    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    cut = F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))
    inside = (F.col(start) >= 0) & (F.col(end) <= F.length(text)) & (F.col(start) < F.col(end))
    return df.where(~(inside & (plain(cut) == plain(F.col(raw)))) | F.col(text).isNull())


def beyond(df: DataFrame, page: str, counts: DataFrame, key: str, most: str) -> DataFrame:
    """Pages past their document's live page count."""
    return df.join(counts, key).where(F.col(page) > F.col(most))


def report(rules: dict[str, DataFrame]) -> DataFrame:
    """``(rule, violations)`` of every rule, zeros too."""
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, parts)
