"""Queries over the smaller rules: capture, queues, subscriptions, registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import workflow as W
from recordloom.plans.catalogue import query, values
from recordloom.tables import observations, table


@query(
    """SELECT o_custkey AS capture, COUNT(*) AS "rows", COALESCE(BOOL_AND(o_orderstatus <> 'P' OR o_totalprice > 1000), FALSE) AND o_custkey % 11 <> 0 AS asserted FROM orders GROUP BY o_custkey"""
)
def positive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("capture"), "o_orderstatus", "o_totalprice")
    totals = rows.groupBy("capture").agg(F.count(F.lit(1)).alias("total")).withColumn("dropped", F.when(F.col("capture") % 11 == 0, 1).otherwise(0))
    return W.asserted(rows, "capture", {"status": (F.col("o_orderstatus") != "P") | (F.col("o_totalprice") > 1000)}, totals)


@query("SELECT * FROM (VALUES ('a', 20, 'done'), ('b', 0, 'empty'), ('c', 10000, 'capped'), ('d', 7, 'partial')) t(slice, \"rows\", verdict)")
def slice_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = values(spark, "slice string, rows long, total long", [("a", 10, 20), ("a", 10, 20), ("b", 0, 0), ("c", 5000, 10000), ("c", 5000, 10000), ("d", 7, 9)])
    return W.slice_verdict(pages, "slice")


@query("SELECT * FROM (VALUES ('f:2024-01[15..31]'), ('f:2024-02'), ('f:2024-03[1..10]')) t(slice_key)")
def month_slice_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: F.to_date(F.lit(x))
    return spark.range(1).select(F.explode(W.month_slices(d("2024-01-15"), d("2024-03-10"), F.lit("f"))).alias("slice_key"))


@query(
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate >= DATE '1996-01-01'), n AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) - 1 AS k FROM d) SELECT COUNT(*) AS days FROM n WHERE d - DATE '1996-01-01' = k"
)
def walked_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return W.contiguous_days(o, "day", F.to_date(F.lit("1996-01-01")))


@query("SELECT strftime(MIN(m), '%Y-%m-%d %H:%M:%S') AS last_polled FROM (SELECT MAX(ts) AS m FROM events GROUP BY event_type)")
def last_polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.last_polled(observations(spark, sf_dir), "kind", "ts").select(F.date_format("last_polled", "yyyy-MM-dd HH:mm:ss").alias("last_polled"))


@query(
    "SELECT event_id, strftime((SELECT MAX(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = a.event_type AND epoch(b.ts)::BIGINT <= epoch(a.ts)::BIGINT - 900), '%Y-%m-%d %H:%M:%S') AS previous FROM events a"
)
def previous_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).select("event_id", "key", "kind", "ts")
    return W.previous_at_least(e, ["key", "kind"], "ts", 15).select("event_id", F.date_format("previous", "yyyy-MM-dd HH:mm:ss").alias("previous"))


@query("SELECT event_id, replaces FROM (SELECT event_id, md5(event_type) AS sha, LAG(md5(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) AS replaces FROM events) WHERE replaces <> sha")
def document_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).select("event_id", "key", F.md5("kind").alias("sha"))
    return W.replaced(e, "key", "event_id", "sha").select("event_id", "replaces")


@query("SELECT * FROM (VALUES ('FD_1', 'observed'), ('AB_55', 'inferred'), ('AB_55_1', 'observed'), ('EP_9_2', 'observed')) t(docket, source)")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = values(spark, "docket string", [("FD_1",), ("AB_55_1",), ("EP_9_2",), ("NOR_7",), ("FD_1_3",)])
    return W.minted_parents(seen, values(spark, "docket string", [("EP_9",), ("NOR_7",), ("FD_1_3",)]))


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, 1), (5, 5)) t(docket_id, proceeding_id)")
def proceeding_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, None, "Main"), (2, 1, None), (3, 1, "Own caption"), (4, 1, "Main"), (5, None, None)]
    return W.proceeding(values(spark, "docket_id int, parent_id int, caption string", rows))


@query("SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3)) t(docket_id, target)")
def follow_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "docket_id int, prefix string, parent int", [(1, "FD", None), (2, "FD", 1), (3, "AB", 1)])
    return rows.select("docket_id", W.followed(F.col("prefix"), F.col("docket_id"), F.col("parent")).alias("target"))


@query(
    """SELECT state, COUNT(*) AS n FROM (SELECT CASE WHEN user_id % 3 = 0 AND ts < TIMESTAMP '2024-01-04' THEN CASE WHEN event_id % 4 >= 3 THEN 'failed' ELSE 'pending' END WHEN user_id % 3 = 0 THEN 'leased' ELSE 'done' END AS state FROM events) GROUP BY state"""
)
def lease_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).select(F.when(F.col("key") % 3 == 0, "leased").otherwise("done").alias("state"), F.col("ts").alias("until"), (F.col("event_id") % 4).alias("attempts"))
    now = F.to_timestamp_ntz(F.lit("2024-01-04 00:00:00"))
    return e.groupBy(W.lease_outcome(F.col("state"), F.col("until"), F.col("attempts"), F.lit(3), now).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_orderkey AS document, CASE WHEN BOOL_OR(l_linestatus = 'O' AND l_returnflag = 'N') THEN 'open' WHEN BOOL_AND(l_returnflag = 'R') THEN 'whole' ELSE 'reread' END AS known FROM lineitem GROUP BY 1"""
)
def queue_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.when(open_, "pending").when(F.col("l_returnflag") == "R", "done").otherwise("failed").alias("state"))
    return W.queue_knowledge(jobs, "document")


@query(
    """WITH a AS (SELECT user_id AS key, COUNT(*) AS attempts, MAX(ts) AS asked_at FROM events WHERE event_type = 'signup' GROUP BY 1),
    s AS (SELECT *, CASE WHEN attempts >= 18 THEN 'exhausted' WHEN asked_at > TIMESTAMP '2024-01-06 12:00:00' THEN 'resting' ELSE 'due' END AS state FROM a)
    SELECT key, CASE WHEN state = 'due' AND ROW_NUMBER() OVER (PARTITION BY state ORDER BY key) > 10 THEN 'waiting' ELSE state END AS state FROM s"""
)
def caption_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = observations(spark, sf_dir).where("kind = 'signup'").groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("asked_at"))
    return W.triage(asks, 18, F.to_timestamp_ntz(F.lit("2024-01-06 12:00:00")), 10, [F.asc("key")]).select("key", "state")


@query(
    "SELECT event_id, recent FROM (SELECT event_id, (SELECT COUNT(*) FROM events b WHERE b.user_id = a.user_id AND epoch(b.ts)::BIGINT BETWEEN epoch(a.ts)::BIGINT - 86400 AND epoch(a.ts)::BIGINT) AS recent FROM events a) WHERE recent > 12"
)
def confirmation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.over_rate(observations(spark, sf_dir), "key", "ts", 24, 12).select("event_id", "recent")


@query("SELECT s_nationkey AS address, o_orderkey AS event, MIN(s_suppkey) AS subscription FROM supplier JOIN orders ON o_custkey = s_suppkey GROUP BY 1, 2")
def claims_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, o = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "orders")
    m = s.join(o, s["s_suppkey"] == o["o_custkey"]).select(F.col("s_nationkey").alias("address"), F.col("o_orderkey").alias("event"), F.col("s_suppkey").alias("subscription"))
    return W.claimed_once(m, ["address"], "event", "subscription")


@query(
    """WITH d AS (SELECT o_orderpriority AS action, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders GROUP BY 1, 2)
    SELECT action, strftime(month, '%Y-%m') AS month, CASE WHEN month > DATE '2001-01-01' THEN 'future' WHEN n >= day(last_day(month)) THEN 'covered' WHEN n > 0 THEN 'partial' ELSE 'uncovered' END AS state FROM d"""
)
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("action"), F.to_date("o_orderdate").alias("d"))
    n = d.groupBy("action", F.trunc("d", "month").alias("month")).agg(F.countDistinct("d").alias("n"))
    state = W.coverage_state(F.col("n"), F.day(F.last_day("month")), F.col("month") > F.to_date(F.lit("2001-01-01")))
    return n.select("action", F.date_format("month", "yyyy-MM").alias("month"), state.alias("state"))


@query("SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def file_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return W.file_positions(c, ["conv_id"], "turn")


@query("SELECT '2024-02-29' AS latest")
def latest_plausible_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "d string", [("2024-02-29",), ("2024-02-30",), ("2030-01-01",), (None,), ("x",)])
    return W.latest_plausible(rows, "d", F.to_date(F.lit("2024-12-31"))).select(F.date_format("latest", "yyyy-MM-dd").alias("latest"))


@query("SELECT round(SUM(w * h / s) / SUM(w), 6) AS share FROM (SELECT lang, COUNT(*) AS w, SUM(CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) * 1.0 AS h, COUNT(*) AS s FROM documents GROUP BY lang)")
def stratified_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("n_chars") > 1000).alias("hits"))
    return W.stratified(strata.withColumn("sampled", F.col("size")), "size", "sampled", "hits")


@query(
    """SELECT CAST(floor(p_partkey / 100) * 100 AS BIGINT) AS band, COUNT(*) AS families, CAST(SUM(CASE WHEN h.l_partkey IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS held FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 49) h ON p_partkey = h.l_partkey GROUP BY 1"""
)
def registry_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.functions.scalars import band

    held = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey")
    joined = p.join(held, p["p_partkey"] == held["l_partkey"], "left")
    return joined.groupBy(band(F.col("p_partkey"), 100).alias("band")).agg(F.count(F.lit(1)).alias("families"), F.count_if(F.col("l_partkey").isNotNull()).alias("held"))
