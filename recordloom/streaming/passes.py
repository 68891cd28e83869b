"""Structured Streaming forms of the ledger's time-bound rules.

Each takes a streaming or batch DataFrame with an event-time column and returns one; sinks are
the caller's.  State is bounded by watermarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordloom.functions.scalars import latency_bucket


def reobserved_once(events: DataFrame, at: str, key: list[str], window: str = "7 days") -> DataFrame:
    """A trailing window asked again and again: each key once within the watermark."""
    return events.withWatermark(at, window).dropDuplicatesWithinWatermark(key)


def hour_counters(events: DataFrame, at: str, by: list[str], value: str, delay: str = "2 hours") -> DataFrame:
    """Requests an hour by class and latency bucket."""
    return (
        events.withWatermark(at, delay)
        .groupBy(F.window(at, "1 hour").alias("w"), *by, latency_bucket(F.col(value)).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("hour"), *by, "bucket", "n")
    )


def folded_days(counters: DataFrame, hour: str, by: list[str], cutoff: Column) -> DataFrame:
    """Hourly counters, those before the cutoff added up to days."""
    start = F.when(F.col(hour) < cutoff, F.date_trunc("day", hour)).otherwise(F.col(hour))
    grain = F.when(F.col(hour) < cutoff, "day").otherwise("hour")
    return counters.groupBy(start.alias("start"), grain.alias("grain"), *by).agg(F.sum("n").alias("n"))


def polling_passes(events: DataFrame, at: str, by: list[str], gap: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a source's captures: a pass ends when nothing follows within the gap."""
    return (
        events.withWatermark(at, delay)
        .groupBy(F.session_window(at, gap).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
    )


def sliding_weeks(events: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """Counts over seven days, moved a day at a time."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "7 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("since"), "n")


def digest_day(at: Column, zone: str = "America/New_York", hour: int = 23) -> Column:
    """The day of the daily digest that an instant goes to: days end at 23:00 local time."""
    local = F.from_utc_timestamp(at, zone)
    return F.to_date(local + F.expr(f"interval {24 - hour} hours"))


def alerts_past_marks(events: DataFrame, key: str, order: str, forward: Column) -> DataFrame:
    """Forward events of each key that are newer than the newest one told of before.

    The mark is a key's state; backfilled events move neither marks nor alerts.
    """
    kind = events.schema[key].dataType.simpleString()

    def tell(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else -1
        top, told = mark, []
        for frame in frames:
            new = frame[frame["o"] > mark]
            told += new["o"].tolist()
            top = max([top, *new["o"].tolist()])
        state.update((top,))
        yield pd.DataFrame({"k": [k[0]] * len(told), "o": sorted(told)})

    return (
        events.where(forward)
        .select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"))
        .groupBy("k")
        .applyInPandasWithState(tell, f"k {kind}, o long", "mark long", "append", GroupStateTimeout.NoTimeout)
        .select(F.col("k").alias(key), F.col("o").alias(order))
    )
