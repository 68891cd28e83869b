"""Counts over records: a record entered in several proceedings counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_records(df: DataFrame, by: list[str], record: str, within: str, date: str) -> DataFrame:
    """Distinct records and proceedings with first and last date, by group."""
    return df.groupBy(*by).agg(
        F.countDistinct(record).alias("records"),
        F.countDistinct(within).alias("proceedings"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def match_types(types: DataFrame, column: str, needle: str) -> DataFrame:
    """Types that equal the needle whatever the case, or else all that contain it."""
    low = F.lower(column)
    exact, part = low == needle.lower(), low.contains(needle.lower())
    marked = types.where(part).withColumn("_exact", exact)
    any_exact = F.max("_exact").over(Window.partitionBy(F.lit(1)))
    # At most as many rows as there are types, which is a small register.
    return marked.withColumn("_any", any_exact).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def holders_of_both(df: DataFrame, group: str, type_col: str, record: str, a: str, b: str) -> DataFrame:
    """Groups that hold two different records, one of each type."""
    return (
        df.groupBy(group)
        .agg(F.count_if(F.col(type_col) == a).alias("n_a"), F.count_if(F.col(type_col) == b).alias("n_b"), F.countDistinct(record).alias("n"))
        .where("n_a > 0 and n_b > 0 and n > 1")
    )


def top_groups(counts: DataFrame, count: str, name: str, k: int = 10) -> DataFrame:
    """The k largest groups, ties by name."""
    return counts.orderBy(F.desc(count), F.asc(name)).limit(k)


def month_spine(df: DataFrame, date: str) -> DataFrame:
    """Every month from a frame's first to its last date."""
    ends = df.agg(F.trunc(F.min(date), "month").alias("lo"), F.trunc(F.max(date), "month").alias("hi"))
    return ends.where("lo is not null").select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month"))


def dense_months(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts of each frame by month, over all months of all of them, zeros filled in."""
    every, counts = None, []
    for name, (df, date) in parts.items():
        dates = df.select(F.col(date).alias("d"))
        every = dates if every is None else every.union(dates)
        counts.append((name, df.groupBy(F.trunc(date, "month").alias("month")).agg(F.count(F.lit(1)).alias(name))))
    out = month_spine(every, "d")
    for name, n in counts:
        out = out.join(n, "month", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def dense_from(counts: DataFrame, year: str, n: str, least: int) -> DataFrame:
    """Years up to the first from which on every year has more than ``least`` records."""
    onward = Window.orderBy(year).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marked = counts.withColumn("_ok", F.min(n).over(onward) > least)  # a row for each year
    first = marked.where("_ok").agg(F.min(year).alias("_first"))
    return marked.join(F.broadcast(first), (F.col("_first").isNull()) | (F.col(year) <= F.col("_first"))).select(year, n)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """Per cent, of one at least."""
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), digits)
