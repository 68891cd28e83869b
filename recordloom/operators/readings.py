"""Readings of pages: what a load does to what is held, and what citing passes walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loaded(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each incoming reading of ``(document, page, role, key, text, agreement)``.

    Refused if its key is live on the page in another role; unchanged if the role's holder has the
    same key, text and agreement; superseded if it has not; asserted if there is no holder.
    """
    at = ["document", "page"]
    holder = live.select(*at, "role", F.struct("key", "text", "agreement").alias("_held"))
    other = live.select(*at, F.col("role").alias("_role"), F.col("key").alias("_key"))
    crossed = incoming.join(other, [*at]).where("key = _key and role <> _role").select(*at, "role", "key").distinct().withColumn("_crossed", F.lit(True))
    joined = incoming.join(crossed, [*at, "role", "key"], "left").join(holder, [*at, "role"], "left")
    outcome = (
        F.when(F.col("_crossed"), "refused")
        .when(F.col("_held").isNull(), "asserted")
        .when(F.col("_held").eqNullSafe(F.struct("key", "text", "agreement")), "unchanged")
        .otherwise("superseded")
    )
    return joined.select(*at, "role", outcome.alias("outcome"))


def routed_load(live: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of route verdicts ``(document, page, route, routed_at)``: an older verdict that differs
    is stale and writes nothing."""
    held = live.select("document", "page", F.col("route").alias("_route"), F.col("routed_at").alias("_at"))
    outcome = (
        F.when(F.col("_route").isNull(), "asserted")
        .when(F.col("_route") == F.col("route"), "unchanged")
        .when(F.col("routed_at") < F.col("_at"), "stale")
        .otherwise("superseded")
    )
    return incoming.join(held, ["document", "page"], "left").select("document", "page", outcome.alias("outcome"))


def paginated(live: DataFrame, incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome of page counts ``(document, page_count)``; live ones say whether a person asserted them."""
    held = live.select("document", F.col("page_count").alias("_n"), F.col("human").alias("_human"))
    there = known.select("document").distinct().withColumn("_known", F.lit(True))
    outcome = (
        F.when(F.col("_known").isNull(), "unknown_document")
        .when(F.col("_n").isNull(), "asserted")
        .when(F.col("_n") == F.col("page_count"), "unchanged")
        .when(F.col("_human"), "human_held")
        .otherwise("superseded")
    )
    return incoming.join(there, "document", "left").join(held, "document", "left").select("document", outcome.alias("outcome"))


def worst(outcomes: DataFrame, document: str, order: list[str]) -> DataFrame:
    """Of each document the outcome that comes first in an order of precedence."""
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("outcome"))
    return outcomes.groupBy(document).agg(F.min_by("outcome", rank).alias("outcome"))


def attempts(dispatches: DataFrame, document: str, at: str, dispatch: str) -> DataFrame:
    """Attempt numbers, which are never stored."""
    return dispatches.withColumn("attempt", F.row_number().over(Window.partitionBy(document).orderBy(at, dispatch)))


def displayed(primary: DataFrame, human: DataFrame) -> DataFrame:
    """The visible reading of each page: a live human one hides the primary."""
    return primary.join(human.select("document", "page"), ["document", "page"], "left_anti").unionByName(human)


def walked(pages: DataFrame) -> DataFrame:
    """Channels of documents that a citing pass walks: machine ones with a page that isn't blank."""
    machine = pages.where("channel <> 'human'")
    return machine.groupBy("document", "channel").agg(F.count(F.lit(1)).alias("pages"), F.max(F.trim("text") != "").alias("_any")).where("_any").drop("_any")


def own_sets(carriers: DataFrame, dockets: DataFrame) -> DataFrame:
    """A document's own keys: of the dockets that carry it, their parents and their siblings."""
    family = dockets.select("docket_id", F.coalesce("parent_id", "docket_id").alias("family"))
    every = family.join(dockets.select(F.coalesce("parent_id", "docket_id").alias("family"), "key"), "family").select("docket_id", "key").distinct()
    return carriers.join(every, "docket_id").groupBy("document").agg(F.array_sort(F.collect_set("key")).alias("own"))


def method_ranks(rules: DataFrame, channels: DataFrame) -> DataFrame:
    """Precedence of rule r on channel c: 1 + 2c + r.  A row for each pair of two small registers."""
    grid = rules.withColumn("_j", F.lit(1)).join(channels.withColumn("_j", F.lit(1)), "_j")
    return grid.select("rule", "channel", (1 + 2 * F.col("channel_no") + F.col("rule_no")).alias("precedence"))


def scorecard(counts: DataFrame) -> DataFrame:
    """Recall and precision of classes from their counts; null without a denominator."""
    def share(part: str, whole: Column) -> Column:
        return F.round(F.col(part) / F.nullif(whole, F.lit(0)), 4)

    return counts.select("class", share("found", F.col("targets")).alias("recall"), share("right", F.col("shown")).alias("precision"))


def cited_form(asked: DataFrame, decisions: DataFrame, dockets: DataFrame) -> DataFrame:
    """``(ask_id, docket_id, served)`` to the one decision of the docket's family served that day, else to its sheet."""
    family = dockets.select("docket_id", F.coalesce("parent_id", "docket_id").alias("family"))
    days = decisions.join(family, "docket_id").groupBy("family", "served").agg(F.countDistinct("decision_id").alias("_n"), F.min("decision_id").alias("_d"))
    joined = asked.join(family, "docket_id", "left").join(days, ["family", "served"], "left")
    return joined.select("ask_id", F.when(F.col("_n") == 1, F.col("_d")).alias("decision_id"), F.when(F.coalesce("_n", F.lit(0)) != 1, F.col("docket_id")).alias("sheet"))


def signature(index: DataFrame, key: str) -> DataFrame:
    """A row that changes if an index has to be rebuilt."""
    return index.agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last"), F.sum(F.crc32(F.to_json(F.struct(*index.columns)).cast("binary"))).alias("sum"))
