"""Queries over readings of pages and citing passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import readings as P
from recordloom.plans.catalogue import query, values
from recordloom.tables import observations, table

_READING = "document string, page int, role string, key string, text string, agreement double"


@query("SELECT * FROM (VALUES ('a', 1, 'primary', 'unchanged'), ('a', 2, 'primary', 'superseded'), ('a', 3, 'second', 'refused'), ('b', 1, 'primary', 'asserted')) t(document, page, role, outcome)")
def reading_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = [("a", 1, "primary", "k1", "t", None), ("a", 2, "primary", "k1", "t", 0.1), ("a", 3, "primary", "k1", "t", None)]
    new = [("a", 1, "primary", "k1", "t", None), ("a", 2, "primary", "k2", "u", 0.1), ("a", 3, "second", "k1", "t", None), ("b", 1, "primary", "k1", "t", None)]
    return P.loaded(values(spark, _READING, live), values(spark, _READING, new))


@query("SELECT * FROM (VALUES ('a', 'stale'), ('b', 'asserted'), ('c', 'superseded')) t(document, outcome)")
def route_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "document string, page int, route string, routed_at int"
    live = values(spark, kind, [("a", 1, "text", 9), ("a", 2, "blank", 9), ("c", 1, "text", 1)])
    new = values(spark, kind, [("a", 1, "table", 5), ("a", 2, "blank", 1), ("b", 1, "text", 1), ("c", 1, "table", 2)])
    return P.worst(P.routed_load(live, new), "document", ["stale", "superseded", "asserted", "unchanged"])


@query("SELECT * FROM (VALUES ('a', 'unchanged'), ('b', 'superseded'), ('c', 'human_held'), ('d', 'asserted'), ('e', 'unknown_document')) t(document, outcome)")
def pagination_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = values(spark, "document string, page_count int, human boolean", [("a", 3, False), ("b", 3, False), ("c", 3, True)])
    new = values(spark, "document string, page_count int", [("a", 3), ("b", 4), ("c", 4), ("d", 1), ("e", 1)])
    return P.paginated(live, new, values(spark, "document string", [("a",), ("b",), ("c",), ("d",)]))


@query("SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events")
def attempt_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.attempts(observations(spark, sf_dir), "key", "ts", "event_id").select("event_id", "attempt")


@query(
    """SELECT conv_id AS document, turn AS page, role FROM conversations c WHERE role = 'user' OR (role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations h WHERE h.role = 'user' AND h.conv_id = c.conv_id AND h.turn = c.turn))"""
)
def displayed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), "role")
    return P.displayed(c.where("role = 'assistant'"), c.where("role = 'user'"))


@query("SELECT conv_id AS document, role AS channel, COUNT(*) AS pages FROM conversations WHERE role <> 'system' GROUP BY 1, 2 HAVING MAX(CASE WHEN trim(text) <> '' THEN 1 ELSE 0 END) = 1")
def walked_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.when(F.col("role") == "system", "human").otherwise(F.col("role")).alias("channel"), "text")
    return P.walked(c)


@query("SELECT * FROM (VALUES ('x', 'FD 1,FD 1 (1),FD 1 (2)'), ('y', 'AB 9')) t(document, own)")
def own_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    dockets = values(spark, "docket_id int, parent_id int, key string", [(1, None, "FD 1"), (2, 1, "FD 1 (1)"), (3, 1, "FD 1 (2)"), (9, None, "AB 9")])
    out = P.own_sets(values(spark, "document string, docket_id int", [("x", 2), ("y", 9)]), dockets)
    return out.select("document", F.array_join("own", ",").alias("own"))


@query("SELECT * FROM (VALUES ('held', 'text-layer', 1), ('held', 'ocr', 3), ('repaired', 'text-layer', 2), ('repaired', 'ocr', 4)) t(rule, channel, precedence)")
def method_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.method_ranks(values(spark, "rule string, rule_no int", [("held", 0), ("repaired", 1)]), values(spark, "channel string, channel_no int", [("text-layer", 0), ("ocr", 1)]))


@query("SELECT * FROM (VALUES ('own', 0.9778, 0.9809), ('none', NULL, NULL)) t(class, recall, precision)")
def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scorecard(values(spark, "class string, found long, targets long, right long, shown long", [("own", 220, 225, 205, 209), ("none", 0, 0, 0, 0)]))


@query("SELECT * FROM (VALUES (1, 53210, NULL), (2, NULL, 2), (3, NULL, 1), (4, NULL, 77)) t(ask_id, decision_id, sheet)")
def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    dockets = values(spark, "docket_id int, parent_id int", [(1, None), (2, 1), (3, None)])
    decisions = values(spark, "decision_id int, docket_id int, served string", [(53210, 2, "2026-08-21"), (53210, 1, "2026-08-21"), (53211, 1, "2026-08-22"), (53212, 2, "2026-08-22")])
    return P.cited_form(values(spark, "ask_id int, docket_id int, served string", [(1, 1, "2026-08-21"), (2, 2, "2026-08-22"), (3, 1, "2020-01-01"), (4, 77, "2026-08-21")]), decisions, dockets)


@query("SELECT COUNT(*) AS n, MAX(doc_id) AS last FROM documents")
def index_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.signature(table(spark, sf_dir, "documents"), "doc_id").select("n", "last")
