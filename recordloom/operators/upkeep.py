"""Keeping citations, readings, parties and pins as they should be: what ranks, what is retired, what is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_of(candidates: DataFrame, key: list[str], order: list[Column], vetoed: DataFrame | None = None) -> DataFrame:
    """One row of each key: the first in order of those that no veto has, whatever the vetoed ones rank."""
    left = candidates if vetoed is None else candidates.join(vetoed, key, "left_anti")
    rows = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return left.withColumn("_k", rows).where("_k = 1").drop("_k")


def refused(findings: DataFrame) -> DataFrame:
    """Why a load of a document's findings ``(document, page, key, channel, passage, page_text)`` is refused: its
    channels are mixed, or a passage isn't on its page; null if it may be loaded."""
    by = findings.groupBy("document").agg(F.countDistinct("channel").alias("channels"), F.count_if(~F.contains("page_text", "passage")).alias("unquoted"))
    return by.select("document", F.when(F.col("channels") > 1, "mixed channels").when(F.col("unquoted") > 0, "unquoted").alias("refused"))


def retracted(live: DataFrame, walked: DataFrame, emitted: DataFrame, kept: DataFrame) -> DataFrame:
    """Live keys to retire: of an older version, on pages that this pass walked, not found again, not decided by a
    person or read on another channel (``kept``); each with the one refined key ``key (...)`` that was found instead."""
    gone = live.join(walked, ["document", "page"], "left_semi").join(emitted, ["document", "page", "key"], "left_anti").join(kept, ["document", "page", "key"], "left_anti")
    refined = emitted.select("document", "page", F.substring_index("key", " (", 1).alias("short"), F.col("key").alias("refined")).where("refined <> short")
    met = gone.join(refined.withColumnRenamed("short", "key"), ["document", "page", "key"], "left")
    by = met.groupBy("document", "page", "key").agg(F.count("refined").alias("n"), F.min("refined").alias("one"))
    return by.select("document", "page", "key", F.when(F.col("n") == 1, F.col("one")).alias("successor"))


def repointed(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each row with the current one of its key, null for the current one itself."""
    last = F.max(order).over(Window.partitionBy(*key))
    return rows.withColumn("points_at", F.when(F.col(order) < last, last))


def gained_and_lost(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """How many rows gained a value that the one before of their key had not, and how many lost one."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    marked = rows.withColumns({"_before": before, "_first": first}).where("not _first")
    return marked.agg(F.count_if(F.col("_before").isNull() & F.col(value).isNotNull()).alias("gained"), F.count_if(F.col("_before").isNotNull() & F.col(value).isNull()).alias("lost"))


def judged(actions: DataFrame, machine: DataFrame) -> DataFrame:
    """What a person's decision on a key makes of it: accepted keeps the newest machine outcome and its docket, corrected
    is resolved to the docket that was named, rejected is unresolved, escalated asserts nothing.  ``actions`` has each
    key's last action."""
    met = actions.join(machine, "key", "left")
    action = F.col("action")
    outcome = F.when(action == "accepted", F.col("outcome")).when(action == "corrected", "resolved").when(action == "rejected", "unresolved")
    docket = F.when(action == "accepted", F.col("docket")).when(action == "corrected", F.col("named"))
    return met.where(action != "escalated").select("key", outcome.alias("outcome"), docket.alias("docket"))


def series(families: DataFrame) -> DataFrame:
    """Parents that only index others: five sub-dockets or more and no record of their own."""
    return families.where((F.col("subs") >= 5) & (F.col("own_records") == 0))


def answered(readings: DataFrame, dispatches: DataFrame, hours: int) -> DataFrame:
    """The dispatch that a reading answers: of its document, before it by some hours at most, the newest; each dispatch
    is answered once, by the first reading that it could be of."""
    met = readings.join(dispatches, "document").where((F.col("sent") <= F.col("read")) & (F.col("read") <= F.col("sent") + F.expr(f"interval {hours} hours")))
    newest = met.groupBy("reading", "document").agg(F.max_by("dispatch", F.struct("sent", "dispatch")).alias("dispatch"), F.first("read").alias("read"))
    return newest.groupBy("dispatch").agg(F.min_by("reading", F.struct("read", "reading")).alias("reading"))


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of a foreign key that its table lacks."""
    return child.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).join(parent.select(F.col(key).alias("value")), "value", "left_anti").distinct()


def retried_cells(spans: DataFrame, current: str) -> DataFrame:
    """Cells to be cut again: by an older rule version, or changed since, or cut in doubt."""
    return spans.where((F.col("version") < current) | (F.col("cell") != F.col("cut_from")) | (F.col("confidence") < 1))


def joinable(pairs: DataFrame, reps: DataFrame, retired: DataFrame) -> DataFrame:
    """Whether a person may join two parties: not if they are one already, or their pair was parted before."""
    a, b = reps.select(F.col("party").alias("a"), F.col("rep").alias("ra")), reps.select(F.col("party").alias("b"), F.col("rep").alias("rb"))
    met = pairs.join(a, "a").join(b, "b").join(retired.select("a", "b", F.lit(True).alias("parted")), ["a", "b"], "left")
    return met.select("a", "b", F.when(F.col("ra") == F.col("rb"), "one already").when(F.col("parted"), "parted before").otherwise("may join").alias("verdict"))


def resolved_rounds(cells: DataFrame, known: DataFrame, rounds: int = 3) -> tuple[DataFrame, int]:
    """Split and resolve until nothing is minted: parties named by the parts ``a and b`` of cells.

    A part that is known as a whole stays whole; each round may make more parts known.  ``rounds``
    more are tried after the first, as a cell needs one for each level of its list.
    """
    from recordloom.storage import save

    names, open_, turn = save(known.select("name").distinct(), "names"), cells.select("name").distinct(), 0
    while turn <= rounds:
        pending = open_.join(names, "name", "left_anti")
        parts = pending.select(F.explode(F.when(F.col("name").contains(" and "), F.split("name", " and ", 2)).otherwise(F.array("name"))).alias("name"), F.col("name").contains(" and ").alias("cut"))
        parts = save(parts, "parts")
        minted = parts.where("not cut or not contains(name, ' and ')").select("name").distinct().join(names, "name", "left_anti")
        names = save(names.unionByName(minted), "names")
        open_, turn = parts.where("contains(name, ' and ')").select("name").distinct(), turn + 1
        if open_.isEmpty():
            break
    return names, turn
