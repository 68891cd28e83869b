"""Capture, walking, queues and subscriptions: verdicts and outcomes as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.functions.scalars import OWN_PROCEEDING_PREFIXES


def asserted(rows: DataFrame, capture: str, checks: dict[str, Column], totals: DataFrame) -> DataFrame:
    """Whether a capture's filter is proved: every row meets every criterion, none was dropped, and
    a total above zero has rows.  ``totals`` is ``(capture, total, dropped)``."""
    every = F.lit(True)
    for c in checks.values():
        every &= F.coalesce(c, F.lit(False))
    seen = rows.groupBy(capture).agg(F.bool_and(every).alias("_ok"), F.count(F.lit(1)).alias("_n"))
    joined = totals.join(seen, capture, "left")
    proved = F.coalesce(F.col("_ok"), F.col("total") == 0) & (F.col("dropped") == 0)
    return joined.select(capture, F.coalesce(proved, F.lit(False)).alias("asserted"), F.coalesce("_n", F.lit(0)).cast("long").alias("rows"))


def slice_verdict(pages: DataFrame, slice_col: str, cap: int = 10_000) -> DataFrame:
    """Of each walked slice: empty, capped, done (rows reconcile with the total) or partial."""
    per = pages.groupBy(slice_col).agg(F.sum("rows").alias("rows"), F.max("total").alias("total"))
    verdict = (
        F.when((F.col("rows") == 0) & (F.coalesce("total", F.lit(0)) == 0), "empty")
        .when(F.col("total") >= cap, "capped")
        .when(F.col("rows") == F.col("total"), "done")
        .otherwise("partial")
    )
    return per.select(slice_col, "rows", verdict.alias("verdict"))


def month_slices(lo: Column, hi: Column, action: Column) -> Column:
    """Keys of the months of a range; a month that the range cuts carries its days."""

    def key(m: Column) -> Column:
        a, b = F.greatest(m, lo), F.least(F.last_day(m), hi)
        whole = (a == m) & (b == F.last_day(m))
        name = F.concat(action, F.lit(":"), F.date_format(m, "yyyy-MM"))
        return F.when(whole, name).otherwise(F.concat(name, F.lit("["), F.day(a).cast("string"), F.lit(".."), F.day(b).cast("string"), F.lit("]")))

    return F.transform(F.sequence(F.trunc(lo, "month").cast("date"), F.trunc(hi, "month").cast("date"), F.expr("interval 1 month")), key)


def contiguous_days(asked: DataFrame, day: str, start: Column) -> DataFrame:
    """How many days without a gap were asked from ``start`` on."""
    nth = F.row_number().over(Window.orderBy(day)) - 1  # a row for each day
    return asked.where(F.col(day) >= start).select(day).distinct().withColumn("_n", nth).agg(F.count_if(F.datediff(day, start) == F.col("_n")).alias("days"))


def last_polled(captures: DataFrame, source: str, at: str) -> DataFrame:
    """The oldest of the sources' newest captures; a source never asked doesn't count."""
    return captures.groupBy(source).agg(F.max(at).alias("_m")).agg(F.min("_m").alias("last_polled"))


def previous_at_least(events: DataFrame, key: list[str], at: str, minutes: int) -> DataFrame:
    """Each event with the newest one of its key that is so much older: an as-of join as a range window.

    Times are compared in whole seconds, each rounded to the nearest, halves to the even one.  A null in the key equals nothing.
    """
    seconds = F.rint(F.unix_micros(F.col(at).cast("timestamp")) / 1e6).cast("long")
    w = Window.partitionBy(*key).orderBy("_s").rangeBetween(Window.unboundedPreceding, -60 * minutes)
    known = reduce(lambda p, q: p & q, [F.col(k).isNotNull() for k in key])
    return events.withColumn("_s", seconds).withColumn("previous", F.when(known, F.max(at).over(w))).drop("_s")


def replaced(captures: DataFrame, url: str, order: str, sha: str) -> DataFrame:
    """Captures whose bytes differ from the URL's capture before (the first replaces nothing)."""
    before = F.lag(sha).over(Window.partitionBy(url).orderBy(order))
    return captures.withColumn("replaces", before).where(F.col("replaces").isNotNull() & (F.col("replaces") != F.col(sha)))


def minted_parents(observed: DataFrame, known: DataFrame) -> DataFrame:
    """Docket ids to register: those observed and the parents they imply, but for the known ones."""
    ids = observed.select(F.col("docket").alias("docket"), F.lit("observed").alias("source"))
    parents = observed.where(F.size(F.split("docket", "_")) > 2).select(F.substring_index("docket", "_", 2).alias("docket"), F.lit("inferred").alias("source"))
    every = ids.unionByName(parents).groupBy("docket").agg(F.max("source").alias("source"))  # observed comes after inferred
    return every.join(known.select("docket"), "docket", "left_anti")


def proceeding(dockets: DataFrame) -> DataFrame:
    """Which proceeding a docket's records are shown under: its own if it has no parent or a caption
    of its own, else its parent's.  Rows are ``(docket_id, parent_id, caption)``."""
    parent = dockets.select(F.col("docket_id").alias("_p"), F.col("caption").alias("_pc"))
    joined = dockets.join(parent, F.col("parent_id") == F.col("_p"), "left")
    own = F.col("parent_id").isNull() | ((F.coalesce("caption", F.lit("")) != "") & ~F.col("caption").eqNullSafe(F.col("_pc")))
    return joined.select("docket_id", F.when(own, F.col("docket_id")).otherwise(F.col("parent_id")).alias("proceeding_id"))


def followed(prefix: Column, docket: Column, parent: Column) -> Column:
    """What a subscription follows: a sub-docket follows itself only where it is a proceeding of its own."""
    return F.when(parent.isNull() | prefix.isin(OWN_PROCEEDING_PREFIXES), docket).otherwise(parent)


def lease_outcome(state: Column, lease_until: Column, attempts: Column, most: Column, now: Column) -> Column:
    """State of a job now: an expired lease is pending again, or failed on the last attempt."""
    expired = (state == "leased") & (lease_until < now)
    return F.when(expired & (attempts >= most), "failed").when(expired, "pending").otherwise(state)


def queue_knowledge(jobs: DataFrame, document: str) -> DataFrame:
    """Of each document: open while any page is pending or leased, whole if all are done, else reread."""
    n = F.count(F.lit(1))
    open_, done = F.count_if(F.col("state").isin("pending", "leased")), F.count_if(F.col("state") == "done")
    return jobs.groupBy(document).agg(F.when(open_ > 0, "open").when(done == n, "whole").otherwise("reread").alias("known"))


def triage(asks: DataFrame, attempts: int, rest_after: Column, due_limit: int, order: list[Column]) -> DataFrame:
    """Asks that are exhausted, resting or due; due ones beyond a pass's limit wait."""
    state = F.when(F.col("attempts") >= attempts, "exhausted").when(F.col("asked_at") > rest_after, "resting").otherwise("due")
    marked = asks.withColumn("state", state)
    nth = F.row_number().over(Window.partitionBy("state").orderBy(*order))
    return marked.withColumn("_n", nth).withColumn("state", F.when((F.col("state") == "due") & (F.col("_n") > due_limit), "waiting").otherwise(F.col("state"))).drop("_n")


def over_rate(tokens: DataFrame, who: str, at: str, hours: int, most: int) -> DataFrame:
    """Requests that come after ``most`` others of the same recipient in the trailing hours."""
    w = Window.partitionBy(who).orderBy("_s").rangeBetween(-3600 * hours, Window.currentRow)
    return tokens.withColumn("_s", F.unix_seconds(F.col(at).cast("timestamp"))).withColumn("recent", F.count(F.lit(1)).over(w)).where(F.col("recent") > most).drop("_s")


def claimed_once(matches: DataFrame, who: list[str], event: str, subscription: str) -> DataFrame:
    """Each (address, channel, event) goes to the lowest subscription that asks for it."""
    return matches.groupBy(*who, event).agg(F.min(subscription).alias(subscription))


def coverage_state(days_asked: Column, days: Column, future: Column) -> Column:
    return F.when(future, "future").when(days_asked >= days, "covered").when(days_asked > 0, "partial").otherwise("uncovered")


def file_positions(files: DataFrame, record: list[str], url: str) -> DataFrame:
    """Each file's place among its record's, by URL, from 0."""
    return files.withColumn("position", F.row_number().over(Window.partitionBy(*record).orderBy(url)) - 1)


def latest_plausible(df: DataFrame, column: str, today: Column) -> DataFrame:
    """The latest date that is one and isn't in the future."""
    d = F.try_to_date(F.col(column), "yyyy-MM-dd")
    return df.agg(F.max(F.when(d <= today, d)).alias("latest"))


def stratified(strata: DataFrame, size: str, sampled: str, hits: str) -> DataFrame:
    """A share estimated from strata weighted by their size."""
    weight = F.col(size) / F.sum(size).over(Window.partitionBy(F.lit(1)))  # a row for each stratum
    return strata.withColumn("_w", weight).agg(F.round(F.sum(F.col("_w") * F.col(hits) / F.col(sampled)), 6).alias("share"))
