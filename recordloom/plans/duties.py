"""Queries over capture, queues and alerts: what is owed, proved, marked, sent and reaped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import duties as D
from recordloom.plans.catalogue import query
from recordloom.tables import filings, observations, table


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd")


def _at(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss")


@query("SELECT strftime(MAX(CAST(o_orderdate AS DATE)) - 6, '%Y-%m-%d') AS first, strftime(MAX(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS last FROM orders WHERE o_orderdate <= DATE '2000-06-30'")
def this_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven days that end at the latest plausible date."""
    o = table(spark, sf_dir, "orders").where("o_orderdate <= date'2000-06-30'").agg(F.max(F.to_date("o_orderdate")).alias("d"))
    return o.select(D.week_of(F.col("d")).alias("w")).select(_day("w.first").alias("first"), _day("w.last").alias("last"))


@query("SELECT o_orderpriority AS action, MIN(strftime(o_orderdate, '%Y-%m')) AS first_month FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def first_walked_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From keys such as ``action:1996-03[1..15]``: the first month that was walked."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    keys = o.select(F.concat_ws(":", "o_orderpriority", F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("[1..15]"))).alias("k"))
    return keys.groupBy(F.substring_index("k", ":", 1).alias("action")).agg(F.min(F.regexp_extract("k", r":(\d{4}-\d{2})", 1)).alias("first_month"))


@query("SELECT event_type AS kind, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(MAX(ts), '%Y-%m-%d %H:%M:%S') AS last, COUNT(*) AS captures FROM events WHERE event_type <> 'error' GROUP BY 1")
def watch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first to the last asserted forward capture of a table."""
    e = observations(spark, sf_dir).where("kind <> 'error'").groupBy("kind").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("captures"))
    return e.select("kind", _at("a").alias("first"), _at("b").alias("last"), "captures")


@query(
    """WITH g AS (SELECT c_custkey % 7 AS failure, c_custkey % 5 = 0 AS open FROM customer) SELECT CAST(failure AS VARCHAR) AS failure, 'open twice' AS fault FROM g GROUP BY failure HAVING COUNT(CASE WHEN open THEN 1 END) > 1"""
)
def gap_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    g = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).cast("string").alias("failure"), start.alias("started_at"), F.when(F.col("c_custkey") % 5 != 0, start + F.expr("interval 1 day")).alias("ended_at"))
    return D.open_gap_faults(g)


@query("SELECT c_nationkey AS family_id, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last_entry FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def last_new_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).groupBy("family_id").agg(F.max("filed").alias("d")).select("family_id", _day("d").alias("last_entry"))


@query(
    """WITH a AS (SELECT l_orderkey AS record, l_partkey, CASE WHEN p_size < 25 THEN 'application/pdf' END AS media FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
    SELECT record, string_agg('/file/' || l_partkey || ' ' || coalesce(media, '?'), '; ' ORDER BY '/file/' || l_partkey || ' ' || coalesce(media, '?')) AS files FROM (SELECT DISTINCT * FROM a) GROUP BY record"""
)
def attachment_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's files in the order of their addresses, with the media type of those that are held."""
    line, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    media = F.when(F.col("p_size") < 25, "application/pdf").otherwise("?")
    one = line.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.col("l_orderkey").alias("record"), F.concat(F.lit("/file/"), "l_partkey", F.lit(" "), media).alias("f"))
    return one.groupBy("record").agg(F.array_join(F.array_sort(F.collect_set("f")), "; ").alias("files"))


@query("SELECT c_mktsegment AS prefix, COUNT(*) AS subs, COUNT(CASE WHEN c_acctbal > 0 THEN 1 END) AS captioned, MIN(c_name) AS first_caption FROM customer GROUP BY 1")
def sub_docket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("prefix")).agg(F.count(F.lit(1)).alias("subs"), F.count_if(F.col("c_acctbal") > 0).alias("captioned"), F.min("c_name").alias("first_caption"))


@query(
    """WITH p AS (SELECT user_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS page, CAST(floor(value) AS BIGINT) AS n FROM events),
    s AS (SELECT *, SUM(n) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, SUM(n) OVER (PARTITION BY user_id) AS total FROM p)
    SELECT verdict, COUNT(*) AS n FROM (SELECT CASE WHEN n = 0 AND page = 1 THEN 'trap' WHEN n = 0 AND coalesce(seen, 0) = total THEN 'end' WHEN n = 0 THEN 'retry' WHEN n < 50 THEN 'end' ELSE 'next' END AS verdict FROM s) GROUP BY 1"""
)
def paging_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    by = Window.partitionBy("key").orderBy("event_id")
    p = observations(spark, sf_dir).select("key", "event_id", F.row_number().over(by).alias("page"), F.floor("value").alias("n"))
    seen, total = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum("n").over(Window.partitionBy("key"))
    s = p.withColumns({"seen": seen, "total": total})
    verdict = D.paging_end(F.col("page"), F.col("n"), F.col("n") == 0, 50, F.col("seen"), F.col("total"))
    return s.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS docket_id, COUNT(*) AS total, COUNT(*) >= 25 AS capped FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def display_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that show as many rows as they can may hold more; here a table shows 25."""
    n = filings(spark, sf_dir).groupBy("docket_id").agg(F.count(F.lit(1)).alias("total"))
    return n.select("docket_id", "total", (F.col("total") >= min(25, D.DISPLAY_CAP)).alias("capped"))


@query(
    """WITH m AS (SELECT o_custkey % 50 AS k, strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, MAX(o_totalprice) > 100000 AS done FROM orders GROUP BY 1, 2)
    SELECT k, month, n, LAST_VALUE(CASE WHEN done THEN n END IGNORE NULLS) OVER (PARTITION BY k ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT DISTINCT FROM n AS proved FROM m"""
)
def empty_month_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month is proved empty if the window's total is that of the nearest done month before it."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy((F.col("o_custkey") % 50).alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), (F.max("o_totalprice") > 100000).alias("done"))
    return D.nearest_before(m, "k", "month", F.col("done"), "n").select("k", "month", "n", F.col("neighbour").eqNullSafe(F.col("n")).alias("proved"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS slice FROM orders WHERE strftime(o_orderdate, '%Y-%m') NOT IN (SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_partkey < 20 AND l_returnflag = 'R')")
def slices_to_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk that begins again still has to ask."""
    asked = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("slice")).distinct()
    line = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_partkey") >= 20, "partial").when(F.col("l_returnflag") == "R", "done").otherwise("failed")
    return D.still_to_do(asked, line.select(F.date_format("l_shipdate", "yyyy-MM").alias("slice"), status.alias("status")), "slice")


@query("SELECT event_type AS kind, strftime(CAST(MIN(ts) AS DATE) - 90, '%Y-%m-%d') AS watch_from FROM events WHERE value > 10 GROUP BY 1")
def watch_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first asserted capture, less the window that it asked for."""
    e = observations(spark, sf_dir).where("value > 10").groupBy("kind").agg(F.min(F.to_date("ts")).alias("d"))
    return e.select("kind", F.date_format(F.date_sub("d", 90), "yyyy-MM-dd").alias("watch_from"))


@query("SELECT COUNT(DISTINCT u) AS held, COUNT(DISTINCT CASE WHEN s <= 20 THEN u END) AS held_small FROM (SELECT l_partkey AS u, p_size AS s FROM lineitem JOIN part ON l_partkey = p_partkey UNION SELECT p_partkey, p_size FROM part WHERE p_size > 40)")
def held_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    line = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    both = p.join(line, F.col("p_partkey") == F.col("l_partkey"), "left_semi").union(p.where("p_size > 40"))
    return both.agg(F.countDistinct("p_partkey").alias("held"), F.countDistinct(F.when(F.col("p_size") <= 20, F.col("p_partkey"))).alias("held_small"))


@query(
    """SELECT p_partkey AS url FROM part WHERE p_size % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 2)"""
)
def attachment_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files still to get: of the latest mode, not held, not resting after a refusal."""
    urls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.when(F.col("p_size") % 2 == 0, "forward").otherwise("backfill").alias("mode"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("url"), "l_quantity", "l_returnflag")
    return D.work_list(urls, line.where("l_quantity > 49"), line.where("l_returnflag = 'R' and l_quantity < 2"), "forward").select("url")


@query(
    """WITH s AS (SELECT s_suppkey AS sub, TIMESTAMP '2024-01-01 00:00:00' + s_suppkey * INTERVAL 3 HOUR AS t FROM supplier) SELECT sub, (SELECT MAX(event_id) FROM events WHERE ts <= t) AS mark FROM s"""
)
def first_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing that was there at confirmation is ever sent."""
    hours = F.make_dt_interval(F.lit(0), (F.col("s_suppkey") * 3).cast("int"))
    subs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sub"), (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + hours).alias("confirmed"))
    return D.first_mark(subs, observations(spark, sf_dir).select("event_id", F.col("ts").alias("recorded")))


@query(
    """WITH s AS (SELECT c_custkey AS sub, c_nationkey AS r, CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'now' END AS cadence FROM customer), t AS (SELECT * FROM s WHERE sub % 97 = 0),
    k AS (SELECT * FROM s WHERE sub NOT IN (SELECT sub FROM t) AND NOT (cadence = 'daily' AND r IN (SELECT r FROM t WHERE cadence = 'daily')))
    SELECT k.sub, COUNT(o_orderkey) AS alerts FROM k LEFT JOIN orders ON o_custkey = k.sub GROUP BY 1"""
)
def withdrawals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily withdrawal takes the recipient's daily subscriptions along."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sub"), F.col("c_nationkey").alias("recipient"), F.when(F.col("c_custkey") % 2 == 0, "daily").otherwise("now").alias("cadence"))
    alerts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("alert"), F.col("o_custkey").alias("sub"))
    left, told = D.withdrawn(s, alerts, s.where("sub % 97 = 0"))
    n = told.groupBy("sub").agg(F.count(F.lit(1)).alias("n"))
    return left.join(n, "sub", "left").select("sub", F.coalesce("n", F.lit(0)).cast("long").alias("alerts"))


@query("SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS monday, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS sent FROM events WHERE isodow(ts) = 1 AND hour(ts) >= 6 GROUP BY 1")
def weekly_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whatever passes there are on a Monday, one of them sends."""
    return D.digests(observations(spark, sf_dir), "ts").select(_day("monday").alias("monday"), _at("sent").alias("sent"))


@query(
    """WITH j AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'leased' ELSE 'done' END AS state, ts, event_id % 4 AS attempts, event_id % 10 = 0 AS back FROM events)
    SELECT s AS state, COUNT(*) AS n, CAST(SUM(a) AS BIGINT) AS attempts FROM (SELECT CASE WHEN state <> 'leased' THEN state WHEN back THEN 'pending' WHEN ts < TIMESTAMP '2024-01-04' AND attempts >= 3 THEN 'failed' WHEN ts < TIMESTAMP '2024-01-04' THEN 'pending' ELSE 'leased' END AS s, attempts - CASE WHEN state = 'leased' AND back THEN 1 ELSE 0 END AS a FROM j) GROUP BY 1"""
)
def reaped_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = observations(spark, sf_dir)
    jobs = e.select(F.when(F.col("key") % 3 == 0, "leased").otherwise("done").alias("state"), F.col("ts").alias("lease_until"), (F.col("event_id") % 4).alias("attempts"), (F.col("event_id") % 10 == 0).alias("given_back"))
    after = D.reaped(jobs, F.to_timestamp_ntz(F.lit("2024-01-04 00:00:00")), F.lit(3))
    return after.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query(
    """WITH j AS (SELECT user_id % 40 AS pass, CASE event_type WHEN 'click' THEN 'done' WHEN 'error' THEN CASE WHEN value > 90 THEN 'failed' ELSE 'done' END WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'pending' ELSE 'done' END ELSE 'done' END AS state, ts FROM events),
    n AS (SELECT pass, COUNT(CASE WHEN state = 'pending' THEN 1 END) AS pending, COUNT(CASE WHEN state = 'failed' THEN 1 END) AS failed, COUNT(CASE WHEN state = 'done' THEN 1 END) AS done, MAX(CASE WHEN state = 'done' THEN ts END) AS last FROM j GROUP BY 1)
    SELECT pass, pending, failed, done, CASE WHEN failed * 10 >= failed + done THEN 'failing' WHEN pending = 0 THEN 'done' WHEN last IS NULL OR last < (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR THEN 'stalled' ELSE 'running' END AS status FROM n"""
)
def fleet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes that stall or fail, row by row."""
    e = observations(spark, sf_dir)
    kind = F.col("kind")
    state = F.when((kind == "error") & (F.col("value") > 90), "failed").when((kind == "signup") & (F.col("key") % 2 == 0), "pending").otherwise("done")
    now = F.lit(e.agg(F.max("ts")).first()[0])  # one row
    return D.stalled(e.select((F.col("key") % 40).alias("pass"), state.alias("state"), F.col("ts").alias("at")), now, 1).select("pass", "pending", "failed", "done", "status")


@query(
    """SELECT c_custkey AS docket_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2000-01-01' UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= DATE '1999-06-01')"""
)
def uncaptioned_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proceedings that were only inferred and have lately been active in either table."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    active = o.where("o_orderdate >= date'2000-01-01'").union(o.where("o_orderpriority = '1-URGENT' and o_orderdate >= date'1999-06-01'"))
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return c.join(active, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("docket_id"))


@query("SELECT event_id FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.event_id > a.event_id)")
def pending_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asserted and not processed by a later event of their key."""
    e = observations(spark, sf_dir)
    done = e.where("kind = 'purchase'").groupBy("key").agg(F.max("event_id").alias("upto"))
    return e.where("kind = 'view'").join(done, "key", "left").where("upto is null or event_id > upto").select("event_id")


@query(
    """WITH e AS (SELECT event_type AS kind, ts, value FROM events), w AS (SELECT kind, COUNT(CASE WHEN ts >= (SELECT MAX(ts) FROM events) - INTERVAL 6 HOUR AND value > 99 THEN 1 END) AS week, COUNT(*) AS quarter, BOOL_AND(value >= 0) AS asserted FROM e GROUP BY 1)
    SELECT kind, week = 0 AS quiet, week > 0 OR (quarter > 0 AND asserted) AS believed FROM w"""
)
def quiet_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty window is believed only if the same question over a longer one has rows and asserts."""
    e = observations(spark, sf_dir)
    last = F.lit(e.agg(F.max("ts")).first()[0])  # one row
    w = e.groupBy("kind").agg(F.count_if((F.col("ts") >= last - F.expr("interval 6 hours")) & (F.col("value") > 99)).alias("week"), F.count(F.lit(1)).alias("quarter"), F.bool_and(F.col("value") >= 0).alias("asserted"))
    return w.select("kind", (F.col("week") == 0).alias("quiet"), ((F.col("week") > 0) | ((F.col("quarter") > 0) & F.col("asserted"))).alias("believed"))


@query(
    """SELECT s_suppkey AS party, o_orderkey AS event FROM supplier JOIN customer ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderkey > 100 * s_suppkey AND o_orderpriority = '1-URGENT' QUALIFY ROW_NUMBER() OVER (PARTITION BY s_suppkey ORDER BY o_orderkey DESC) <= 3"""
)
def party_events_after_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A party's newest events after its mark, a few only: each family's newest are few enough to be met."""
    from recordloom.operators.folding import top_in_group

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("party"), "s_nationkey", (100 * F.col("s_suppkey")).alias("mark"))
    f = filings(spark, sf_dir).where("filing_type = '1-URGENT'").select("family_id", F.col("filing_id").alias("event"))
    newest = top_in_group(f, ["family_id"], [F.desc("event")], 3).select("family_id", "event")
    return s.join(newest, F.col("s_nationkey") == F.col("family_id")).where("event > mark").select("party", "event")


@query("SELECT l_partkey AS url, MAX_BY(l_returnflag || l_linenumber, (l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS hash, COUNT(*) AS copies FROM lineitem GROUP BY 1")
def latest_held_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return line.groupBy(F.col("l_partkey").alias("url")).agg(F.max_by(F.concat("l_returnflag", "l_linenumber"), order).alias("hash"), F.count(F.lit(1)).alias("copies"))


@query(
    """WITH h AS (SELECT l_suppkey AS stage, COUNT(CASE WHEN l_returnflag = 'R' AND k <= 5 THEN 1 END) AS unanswered FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS k FROM lineitem) GROUP BY 1),
    d AS (SELECT l_suppkey AS stage, COUNT(DISTINCT l_orderkey) AS waiting FROM lineitem WHERE l_linestatus = 'O' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1)
    SELECT h.stage, unanswered >= 3 AS halted, CASE WHEN unanswered >= 3 THEN least(1, coalesce(waiting, 0)) ELSE coalesce(waiting, 0) END AS sent FROM h LEFT JOIN d ON h.stage = d.stage"""
)
def stage_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage whose last dispatches stay unanswered sends one document only; documents that are gone are not sent."""
    from recordloom.operators.folding import top_in_group

    line = table(spark, sf_dir, "lineitem")
    order = [F.desc(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")]
    last = top_in_group(line, ["l_suppkey"], order, 5).groupBy(F.col("l_suppkey").alias("stage")).agg((F.count_if(F.col("l_returnflag") == "R") >= 3).alias("halted"))
    held = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    waiting = line.where("l_linestatus = 'O'").join(held, "l_orderkey", "left_semi").groupBy(F.col("l_suppkey").alias("stage")).agg(F.countDistinct("l_orderkey").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return last.join(waiting, "stage", "left").select("stage", "halted", F.when(F.col("halted"), F.least(F.lit(1), n)).otherwise(n).cast("long").alias("sent"))
