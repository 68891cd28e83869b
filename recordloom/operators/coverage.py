"""What was asked against what is held: spines, gaps and runs of days and months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.ranges import previous, running_sum

_SLICE = r"^([a-z_]+):(\d{4}-\d{2})(?:\[(\d{1,2})\.\.(\d{1,2})\])?$"


def days(lo: Column, hi: Column) -> Column:
    """Days from lo to hi, none if hi is before lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>"))


def asked_days(slices: DataFrame, key: str = "slice_key", status: str = "status") -> DataFrame:
    """``(action, month, day)`` that finished slices asked for.

    A slice's key is ``action:YYYY-MM`` or ``action:YYYY-MM[lo..hi]``; a range never counts as its
    month.  Malformed keys ask for nothing.
    """
    done = slices.where(F.col(status).isin("done", "empty") & F.col(key).rlike(_SLICE))
    part = [F.regexp_extract(key, _SLICE, k) for k in range(1, 5)]
    month = F.to_date(F.concat(part[1], F.lit("-01")))
    lo = F.when(part[2] != "", F.date_add(month, F.try_to_number(part[2], F.lit("99")).cast("int") - 1)).otherwise(month)
    hi = F.when(part[3] != "", F.date_add(month, F.try_to_number(part[3], F.lit("99")).cast("int") - 1)).otherwise(F.last_day(month))
    return done.select(part[0].alias("action"), month.alias("month"), F.explode(days(lo, F.least(hi, F.last_day(month)))).alias("day")).distinct()


def incomplete_months(asked: DataFrame, first: Column, last: Column) -> DataFrame:
    """Months of the range, by action, of which not all days were asked, and how many are missing."""
    spine = asked.select("action").distinct().select("action", F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    held = asked.groupBy("action", "month").agg(F.countDistinct("day").alias("n"))
    joined = spine.join(held, ["action", "month"], "left")
    missing = F.day(F.last_day("month")) - F.coalesce("n", F.lit(0))
    return joined.select("action", "month", missing.cast("long").alias("missing_days")).where("missing_days > 0")


def runs(df: DataFrame, group: list[str], index: Column, label: str) -> DataFrame:
    """Consecutive indexes of a group as ranges: first and last label and how many."""
    w = Window.partitionBy(*group).orderBy("_i")
    marked = df.withColumn("_i", index).withColumn("_g", F.col("_i") - F.row_number().over(w))
    return marked.groupBy(*group, "_g").agg(F.min(label).alias("first"), F.max(label).alias("last"), F.count(F.lit(1)).alias("n")).drop("_g")


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def gap_shadows(gaps: DataFrame, today: Column, catch_up_days: int = 6, failure: str = "captures") -> DataFrame:
    """Days that gaps leave in doubt: a closed gap all but its last days, an open one up to today."""
    start, end = F.to_date("started_at"), F.to_date("ended_at")
    hi = F.when(F.col("ended_at").isNull(), today).otherwise(F.date_sub(end, catch_up_days))
    return gaps.where(F.col("failure") == failure).select("gap_id", F.explode(days(start, hi)).alias("day"))


def covering(points: DataFrame, at: str, gaps: DataFrame, grace_hours: int = 3) -> DataFrame:
    """Each point with the latest gap that covers it, its end extended by some grace (left join).

    Gaps are bucketed by day, so the range join is an equality join on days.
    """
    grace = F.expr(f"interval {grace_hours} hours")
    until = F.coalesce(F.col("ended_at") + grace, F.to_timestamp_ntz(F.lit("9999-12-31 00:00:00")))
    closed = gaps.where("ended_at is not null").select("gap_id", "started_at", until.alias("_until"), F.explode(F.sequence(F.to_date("started_at"), F.to_date(until))).alias("_day"))
    open_ = gaps.where("ended_at is null").select(F.max(F.struct("started_at", "gap_id")).alias("o"))  # one failure can be open at a time
    hit = points.withColumn("_day", F.to_date(at)).join(closed, "_day", "left")
    inside = (F.col(at) >= F.col("started_at")) & (F.col(at) <= F.col("_until"))
    best = hit.groupBy(*points.columns).agg(F.max(F.when(inside, F.struct("started_at", "gap_id"))).alias("c"))
    both = best.join(F.broadcast(open_), F.lit(True), "left")
    chosen = F.greatest("c", F.when(F.col("o.started_at") <= F.col(at), F.col("o")))
    return both.select(*points.columns, chosen["gap_id"].alias("gap_id"))


def sessions(events: DataFrame, at: str, gap_minutes: int, late_hours: int) -> DataFrame:
    """Passes of events less than a gap apart; late if the pass before ended long ago.

    A pass belongs to the whole ledger, so events are ordered over ranges: a pass begins where
    the event before is a gap away.
    """
    gap = F.expr(f"interval {gap_minutes} minutes")
    begun = previous(events.select(F.col(at).alias("at")), [F.col("at")], "at", "before")
    starts = begun.withColumn("_new", (F.col("before").isNull() | (F.col("at") - F.col("before") >= gap)).cast("long"))
    numbered = running_sum(starts, [F.col("at"), F.desc("_new")], F.col("_new"), "pass")
    passes = numbered.groupBy("pass").agg(F.min("at").alias("started"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_new") == 1, F.col("before"))).alias("before"))
    late = F.coalesce(F.col("started") > F.col("before") + F.expr(f"interval {late_hours} hours"), F.lit(False))
    return passes.select("started", "last", "n", late.alias("late"))
