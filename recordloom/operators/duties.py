"""What capture, queues and alerts owe: spans, proofs, work lists, marks, cascades, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that its source shows at most.
DISPLAY_CAP = 10_000


def week_of(latest: Column) -> Column:
    """First and last day of the seven that end at a date."""
    return F.struct(F.date_sub(latest, 6).alias("first"), latest.alias("last"))


def open_gap_faults(gaps: DataFrame) -> DataFrame:
    """Failures that have more than one open gap, and gaps that end before they begin."""
    twice = gaps.groupBy("failure").agg(F.count_if(F.col("ended_at").isNull()).alias("n")).where("n > 1").select("failure", F.lit("open twice").alias("fault"))
    return twice.unionByName(gaps.where("ended_at < started_at").select("failure", F.lit("ends before it begins").alias("fault")).distinct())


def paging_end(page: Column, rows: Column, envelope: Column, per_page: int, seen: Column, total: Column) -> Column:
    """How a walk goes on after a page: it ends with a short page, or with an envelope without rows that comes
    after the first page when all rows promised were seen; such an envelope on page one is a trap."""
    return (
        F.when(envelope & (page == 1), "trap").when(envelope & (seen == total), "end").when(envelope, "retry").when(rows < per_page, "end").otherwise("next")
    )


def nearest_before(months: DataFrame, key: str, month: str, done: Column, value: str) -> DataFrame:
    """``months`` with ``neighbour``: the value of the nearest earlier month that is done, for an empty month's proof."""
    before = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, -1)
    return months.withColumn("neighbour", F.last(F.when(done, F.col(value)), ignorenulls=True).over(before))


def still_to_do(slices: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Slices that no attempt has done, found empty or capped."""
    return slices.join(attempts.where(F.col("status").isin("done", "empty", "capped")), key, "left_anti")


def work_list(urls: DataFrame, held: DataFrame, resting: DataFrame, latest: str) -> DataFrame:
    """URLs of the latest mode that are not held and do not rest."""
    return urls.where(F.col("mode") == latest).join(held, "url", "left_anti").join(resting, "url", "left_anti")


def first_mark(subscriptions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each subscription's mark: the last event that was recorded when it was confirmed.

    Both are dealt by day: events before the day of confirmation give their day's last id, those of
    the day itself are compared.
    """
    daily = ledger.groupBy(F.to_date("recorded").alias("day")).agg(F.max("event_id").alias("top"), F.max("recorded").alias("until"))
    upto = daily.select("day", F.max("top").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row for each day
    same = subscriptions.join(ledger, F.to_date("confirmed") == F.to_date("recorded"), "left").where(F.col("recorded").isNull() | (F.col("recorded") <= F.col("confirmed")))
    own = same.groupBy("sub").agg(F.max("event_id").alias("own"))
    earlier = daily.select(F.col("day").alias("d"), F.col("top"))
    known = subscriptions.join(upto, F.to_date("confirmed") == F.col("day"), "left")
    missing = known.where("day is null").select("sub", F.to_date("confirmed").alias("c")).join(F.broadcast(earlier), F.col("d") < F.col("c"), "left").groupBy("sub").agg(F.max("top").alias("gap"))  # days without events
    return known.join(own, "sub", "left").join(missing, "sub", "left").select("sub", F.greatest("before", "own", "gap").alias("mark"))


def withdrawn(subscriptions: DataFrame, alerts: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of subscriptions and of alerts ``(alert, sub, event)`` after withdrawals: a daily one takes all daily
    subscriptions of its recipient along, and an alert without events goes."""
    named = subscriptions.join(tokens.select("sub"), "sub", "left_semi")
    whole = named.where("cadence = 'daily'").select("recipient").distinct()
    daily = subscriptions.where("cadence = 'daily'").join(whole, "recipient", "left_semi").select("sub")
    gone = daily.union(named.select("sub")).distinct()
    return subscriptions.join(gone, "sub", "left_anti"), alerts.join(gone, "sub", "left_anti")


def digests(passes: DataFrame, at: str, hour: int = 6) -> DataFrame:
    """The passes that send the weekly digest: of a Monday's from ``hour`` on, the first."""
    monday = passes.where((F.dayofweek(at) == 2) & (F.hour(at) >= hour))
    return monday.groupBy(F.to_date(at).alias("monday")).agg(F.min(at).alias("sent"))


def reaped(jobs: DataFrame, now: Column, most: Column) -> DataFrame:
    """Jobs after leases have run out: pending again, or failed on the last attempt; a lease that a worker gave up
    before it began gets its attempt back."""
    out = (F.col("state") == "leased") & (F.col("lease_until") < now)
    refund = F.when((F.col("state") == "leased") & F.col("given_back"), 1).otherwise(0)
    state = F.when(F.col("state") != "leased", F.col("state")).when(F.col("given_back"), "pending").when(out & (F.col("attempts") >= most), "failed").when(out, "pending").otherwise("leased")
    return jobs.withColumns({"state": state, "attempts": F.col("attempts") - refund})


def stalled(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """Each pass as done, stalled (work left, nothing done for some hours), failing (a tenth or more failed) or running."""
    n = jobs.groupBy("pass").agg(
        F.count_if(F.col("state") == "pending").alias("pending"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "done").alias("done"), F.max(F.when(F.col("state") == "done", F.col("at"))).alias("last_done")
    )
    idle = F.col("last_done").isNull() | (F.col("last_done") < now - F.expr(f"interval {hours} hours"))
    status = F.when(F.col("failed") * 10 >= F.col("failed") + F.col("done"), "failing").when(F.col("pending") == 0, "done").when(idle, "stalled").otherwise("running")
    return n.withColumn("status", status)
