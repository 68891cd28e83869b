"""Queries over time: coverage, passes, counters, traffic, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import coverage, counting
from recordloom.plans.catalogue import query, values
from recordloom.storage import shared_dir
from recordloom.streaming import passes
from recordloom.tables import observations, table

_SLICES = [
    ("filings:2024-01", "done"), ("filings:2024-02[1..10]", "done"), ("filings:2024-02[11..28]", "done"), ("filings:2024-03[1..15]", "empty"),
    ("filings:2024-03[16..31]", "capped"), ("decisions:2024-01[1..31]", "done"), ("decisions:2024-02", "partial"), ("decisions:2024-03", "empty"), ("nonsense", "done"),
]


@query("SELECT * FROM (VALUES ('filings', '2024-02', 1), ('filings', '2024-03', 16), ('decisions', '2024-02', 29)) t(action, month, missing_days)")
def coverage_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range never counts as its month, a capped or partial slice asks for nothing."""
    asked = coverage.asked_days(values(spark, "slice_key string, status string", _SLICES))
    first, last = F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-03-01"))
    out = coverage.incomplete_months(asked, first, last)
    return out.select("action", F.date_format("month", "yyyy-MM").alias("month"), F.col("missing_days").cast("int").alias("missing_days"))


@query(
    """WITH m AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
    g AS (SELECT o_custkey, month, year(month) * 12 + month(month) - ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY month) AS g FROM m)
    SELECT o_custkey AS docket_id, strftime(MIN(month), '%Y-%m') AS first, strftime(MAX(month), '%Y-%m') AS last, COUNT(*) AS n FROM g GROUP BY o_custkey, g"""
)
def month_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("docket_id"), F.trunc(F.to_date("o_orderdate"), "month").alias("month")).distinct()
    out = coverage.runs(o, ["docket_id"], coverage.month_index(F.col("month")), "month")
    return out.select("docket_id", F.date_format("first", "yyyy-MM").alias("first"), F.date_format("last", "yyyy-MM").alias("last"), "n")


_GAPS = [(1, "2024-01-03 06:00:00", "2024-01-12 09:00:00", "captures"), (2, "2024-01-20 00:00:00", "2024-01-23 00:00:00", "captures"), (3, "2024-02-10 12:00:00", None, "captures"), (4, "2024-01-01 00:00:00", "2024-03-01 00:00:00", "mail")]


def _gaps(spark: SparkSession) -> DataFrame:
    rows = values(spark, "gap_id int, s string, e string, failure string", _GAPS)
    return rows.select("gap_id", F.to_timestamp_ntz("s").alias("started_at"), F.to_timestamp_ntz("e").alias("ended_at"), "failure")


@query(
    """WITH g(gap_id, s, e) AS (VALUES (1, DATE '2024-01-03', DATE '2024-01-06'), (3, DATE '2024-02-10', DATE '2024-02-15'))
    SELECT gap_id, strftime(CAST(UNNEST(generate_series(s, e, INTERVAL 1 DAY)) AS DATE), '%Y-%m-%d') AS day FROM g"""
)
def gap_shadow_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed gap shadows all but its last six days, an open one everything up to today."""
    out = coverage.gap_shadows(_gaps(spark), F.to_date(F.lit("2024-02-15")))
    return out.select("gap_id", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    """WITH g(gap_id, s, e) AS (VALUES (1, TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-12 12:00:00'), (2, TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-01-23 03:00:00'), (3, TIMESTAMP '2024-02-10 12:00:00', TIMESTAMP '9999-12-31 00:00:00'))
    SELECT event_id, CAST((SELECT arg_max(gap_id, s) FROM g WHERE ts >= s AND ts <= e) AS INTEGER) AS gap_id FROM events WHERE event_type = 'signup'"""
)
def late_captures_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).where("kind = 'signup'").select("event_id", "ts")
    return coverage.covering(e, "ts", _gaps(spark).where("failure = 'captures'")).select("event_id", "gap_id")


@query(
    """WITH m AS (SELECT ts, CASE WHEN ts - LAG(ts) OVER (ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'purchase'),
    s AS (SELECT ts, SUM(new) OVER (ORDER BY ts) AS k FROM m), p AS (SELECT k, MIN(ts) AS started, MAX(ts) AS last, COUNT(*) AS n FROM s GROUP BY k)
    SELECT strftime(started, '%Y-%m-%d %H:%M:%S') AS started, n, COALESCE(started > LAG(last) OVER (ORDER BY started) + INTERVAL 3 HOUR, FALSE) AS late FROM p"""
)
def pass_sessions_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).where("kind = 'purchase'")
    return coverage.sessions(e, "ts", 15, 3).select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n", "late")


_FOLD = """WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type AS kind, CASE WHEN 10 * value < 100 THEN 'lt100' WHEN 10 * value < 500 THEN 'lt500' WHEN 10 * value < 2000 THEN 'lt2000' ELSE 'ge2000' END AS bucket, COUNT(*) AS n FROM events GROUP BY 1, 2, 3),
    f AS (SELECT CASE WHEN hour < TIMESTAMP '2024-01-04 00:00:00' THEN date_trunc('day', hour) ELSE hour END AS start, CASE WHEN hour < TIMESTAMP '2024-01-04 00:00:00' THEN 'day' ELSE 'hour' END AS grain, kind, bucket, n FROM h)
    SELECT strftime(start, '%Y-%m-%d %H') AS start, grain, kind, bucket, CAST(SUM(n) AS BIGINT) AS n FROM f GROUP BY 1, 2, 3, 4"""


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir).withColumn("ms", 10 * F.col("value"))
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "kind", S.latency_bucket(F.col("ms")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(_FOLD)
def hour_counters_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passes.folded_days(_counters(spark, sf_dir), "hour", ["kind", "bucket"], F.to_timestamp(F.lit("2024-01-04 00:00:00")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "grain", "kind", "bucket", "n")


@query(
    """SELECT event_type AS kind, COUNT(*) AS requests, CAST(SUM(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS crawlers, CAST(SUM(CASE WHEN value >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS failed,
      round(100.0 * SUM(CASE WHEN value < 50 THEN 1 ELSE 0 END) / greatest(COUNT(*), 1), 2) AS fast_share FROM events GROUP BY 1"""
)
def traffic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    n = F.count(F.lit(1))
    return e.groupBy("kind").agg(
        n.alias("requests"), F.count_if(F.col("key") % 10 == 0).alias("crawlers"), F.count_if(F.col("value") >= 90).alias("failed"), counting.share(F.count_if(F.col("value") < 50), n).alias("fast_share")
    )


@query("SELECT CAST(hour(ts) AS INTEGER) AS hour, event_type AS kind, COUNT(*) AS n FROM events GROUP BY 1, 2")
def hour_of_day_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(F.hour("ts").alias("hour"), "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH d AS (SELECT MAX(CAST(ts AS DATE)) AS today FROM events) SELECT event_type AS kind,
      CAST(SUM(CASE WHEN CAST(ts AS DATE) > today - 2 THEN 1 ELSE 0 END) AS BIGINT) AS last_days, CAST(SUM(CASE WHEN CAST(ts AS DATE) <= today - 2 AND CAST(ts AS DATE) > today - 4 THEN 1 ELSE 0 END) AS BIGINT) AS days_before FROM events, d GROUP BY 1"""
)
def trailing_against_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    today = F.lit(e.agg(F.to_date(F.max("ts"))).first()[0])
    day = F.to_date("ts")
    return e.groupBy("kind").agg(
        F.count_if(day > F.date_sub(today, 2)).alias("last_days"), F.count_if((day <= F.date_sub(today, 2)) & (day > F.date_sub(today, 4))).alias("days_before")
    )


@query(
    """SELECT event_type AS pass, CAST(SUM(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(SUM(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS leased, CAST(SUM(CASE WHEN user_id % 3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS done FROM events GROUP BY 1"""
)
def queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.element_at(F.array(F.lit("pending"), F.lit("leased"), F.lit("done")), (F.col("key") % 3 + 1).cast("int"))
    e = observations(spark, sf_dir).select(F.col("kind").alias("pass"), states.alias("state"))
    return e.groupBy("pass").pivot("state", ["pending", "leased", "done"]).agg(F.count(F.lit(1))).select("pass", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pending", "leased", "done")])


# ---------------------------------------------------------------- the same over streams

def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream of one batch."""
    read = spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # Watermarks want instants; the session's zone is UTC.
    return read.withColumns({f.name: F.col(f.name).cast("timestamp") for f in read.schema if f.dataType.typeName() == "timestamp_ntz"})


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream over all that there is puts out."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/recordloom/stream-{uuid.uuid4().hex}"
    out, check = f"{root}/out", f"{root}/state"
    df.writeStream.outputMode(mode).option("checkpointLocation", check).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS keys, MIN(event_id) AS first FROM (SELECT DISTINCT user_id, event_type, event_id FROM events)")
def stream_reobserved_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    doubled = e.union(e)  # every observation asked for twice
    once = _run(passes.reobserved_once(doubled, "ts", ["user_id", "event_type", "event_id"]))
    return once.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("keys"), F.min("event_id").alias("first"))


@query("SELECT user_id, COUNT(*) AS told, MAX(event_id) AS newest FROM events WHERE event_type <> 'error' GROUP BY 1")
def stream_alerts_past_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    told = _run(passes.alerts_past_marks(e, "user_id", "event_id", F.col("event_type") != "error"))
    return told.groupBy("user_id").agg(F.count(F.lit(1)).alias("told"), F.max("event_id").alias("newest"))


@query(
    """SELECT kind, bucket, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT event_type AS kind, CASE WHEN 10 * value < 100 THEN 'lt100' WHEN 10 * value < 500 THEN 'lt500' WHEN 10 * value < 2000 THEN 'lt2000' ELSE 'ge2000' END AS bucket, COUNT(*) AS n
    FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 2 HOUR FROM events) GROUP BY 1, 2) GROUP BY 1, 2"""
)
def stream_hour_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed."""
    e = _stream(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind"), (10 * F.col("value")).alias("ms"))
    closed = _run(passes.hour_counters(e, "ts", ["kind"], "ms"))
    return closed.groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
