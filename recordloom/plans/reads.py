"""Queries that answer whole questions, over tables and over files that were written from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import reads as R
from recordloom.operators import textquality
from recordloom.plans.catalogue import query
from recordloom.plans.timelines import _run, _stream
from recordloom.sources import files
from recordloom.storage import shared_dir
from recordloom.streaming import passes
from recordloom.tables import decision_copies, filings, observations, spread, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS decision_id, n_name AS family, n_regionkey AS region_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY decision_id ORDER BY region_id, family) AS k FROM c)
    SELECT decision_id, family, (SELECT coalesce(string_agg(family, ', ' ORDER BY family), '') FROM c WHERE c.decision_id = r.decision_id AND c.family <> r.family) AS also_in FROM r WHERE k = 1"""
)
def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once, as entered nearest, and where else it stands."""
    c = decision_copies(spark, sf_dir).select("decision_id", "family", "region_id").distinct()
    return R.record_page(c, "decision_id", [F.col("region_id"), F.col("family")], "family").select("decision_id", "family", "also_in")


@query(
    "SELECT l_returnflag AS kind, l_linestatus AS body, COUNT(DISTINCT l_orderkey) AS records, COUNT(DISTINCT s_nationkey) AS proceedings, strftime(MIN(l_shipdate), '%Y-%m-%d') AS first_date, strftime(MAX(l_shipdate), '%Y-%m-%d') AS last_date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"
)
def count_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by = line.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("body"))
    return by.agg(
        F.countDistinct("l_orderkey").alias("records"), F.countDistinct("s_nationkey").alias("proceedings"), F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_date")
    )


@query(
    """WITH w AS (SELECT DATE '1998-03-01' AS a, DATE '1998-03-31' AS b), g(s, e) AS (VALUES (DATE '1998-03-10', DATE '1998-03-14'), (DATE '1998-05-01', DATE '1998-05-02')),
    r AS (SELECT 'filing' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT 'decision', l_orderkey, CAST(l_shipdate AS DATE) FROM lineitem)
    SELECT kind, COUNT(DISTINCT id) AS records, COUNT(DISTINCT CASE WHEN d BETWEEN DATE '1998-03-10' AND DATE '1998-03-14' THEN id END) AS in_gap, (SELECT COUNT(*) FROM g, w WHERE s <= b AND e >= a) AS gaps FROM r, w WHERE d BETWEEN a AND b GROUP BY 1"""
)
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's records by kind, and what should be known of it: gaps that overlap it, and what fell in them."""
    o = table(spark, sf_dir, "orders").select(F.lit("filing").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    line = table(spark, sf_dir, "lineitem").select(F.lit("decision").alias("kind"), F.col("l_orderkey").alias("id"), F.to_date("l_shipdate").alias("d"))
    gaps = spark.createDataFrame([("1998-03-10", "1998-03-14"), ("1998-05-01", "1998-05-02")], "s string, e string")
    met = gaps.where("s <= '1998-03-31' and e >= '1998-03-01'")
    days = F.broadcast(met.select(F.explode(F.sequence(F.to_date("s"), F.to_date("e"))).alias("g")).distinct())  # the gaps' days within reach
    inside = o.union(line).where(F.col("d").between("1998-03-01", "1998-03-31")).join(days, F.col("d") == F.col("g"), "left")
    n = inside.groupBy("kind").agg(F.countDistinct("id").alias("records"), F.countDistinct(F.when(F.col("g").isNotNull(), F.col("id"))).alias("in_gap"))
    return n.join(F.broadcast(met.agg(F.count(F.lit(1)).alias("gaps"))))  # one row


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'person' ELSE 'machine' END AS read_by, CASE WHEN trim(text) <> '' THEN 'text' WHEN role = 'system' THEN 'blank' ELSE 'unread' END AS state, length(text) AS chars FROM conversations WHERE turn BETWEEN 1 AND 3")
def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of a document's displayed pages, with how each was read and what it shows."""
    c = table(spark, sf_dir, "conversations").where("turn between 1 and 3")
    route = F.when(F.col("role") == "system", "blank").otherwise("text")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "person").otherwise("machine").alias("read_by"), S.page_state(route, F.col("text")).alias("state"), F.length("text").cast("long").alias("chars"))


@query(
    """WITH d AS (SELECT l_orderkey AS doc, BOOL_OR(l_linestatus = 'O') AS due, BOOL_OR(l_returnflag = 'R') AS done, COUNT(*) AS pages FROM lineitem GROUP BY 1)
    SELECT COUNT(*) AS eligible, COUNT(CASE WHEN due THEN 1 END) AS due, COUNT(CASE WHEN done AND NOT due THEN 1 END) AS done, COUNT(CASE WHEN NOT done AND NOT due THEN 1 END) AS left_out, CAST(SUM(CASE WHEN due THEN pages END) AS BIGINT) AS pages_due FROM d"""
)
def extraction_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that may be read, are due, are done; the last three add up to the first."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("due"), F.bool_or(F.col("l_returnflag") == "R").alias("done"), F.count(F.lit(1)).alias("pages"))
    due, done = F.col("due"), F.col("done")
    return d.agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(due).alias("due"), F.count_if(done & ~due).alias("done"), F.count_if(~done & ~due).alias("left_out"), F.sum(F.when(due, F.col("pages"))).alias("pages_due")
    )


@query(
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d DESC) AS k FROM d)
    SELECT strftime(MIN(d), '%Y-%m-%d') AS walked_back_to, COUNT(*) AS days FROM n WHERE (SELECT MAX(d) FROM d) - d = k - 1"""
)
def walked_back_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.to_date("o_orderdate").alias("day"))
    return R.walked_back(o, "day").select(F.date_format("walked_back_to", "yyyy-MM-dd").alias("walked_back_to"), "days")


@query(
    """SELECT 'filing' AS kind, COUNT(*) AS "rows", COUNT(DISTINCT o_orderkey) AS records, strftime(MIN(o_orderdate), '%Y-%m-%d') AS first, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last, COUNT(CASE WHEN o_orderdate IS NULL THEN 1 END) AS undated FROM orders
    UNION ALL SELECT 'decision', COUNT(*), COUNT(DISTINCT l_orderkey), strftime(MIN(l_shipdate), '%Y-%m-%d'), strftime(MAX(l_shipdate), '%Y-%m-%d'), COUNT(CASE WHEN l_shipdate IS NULL THEN 1 END) FROM lineitem
    UNION ALL SELECT 'observation', COUNT(*), COUNT(DISTINCT event_id), strftime(MIN(ts), '%Y-%m-%d'), strftime(MAX(ts), '%Y-%m-%d'), COUNT(CASE WHEN ts IS NULL THEN 1 END) FROM events"""
)
def coverage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a table: rows, records, first and last day, rows without one."""

    def row(kind: str, name: str, key: str, at: str) -> DataFrame:
        t = table(spark, sf_dir, name).select(key, at)
        day = [F.date_format(f(at), "yyyy-MM-dd") for f in (F.min, F.max)]
        return t.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("records"), day[0].alias("first"), day[1].alias("last"), F.count_if(F.col(at).isNull()).alias("undated")).select(F.lit(kind).alias("kind"), "*")

    return row("filing", "orders", "o_orderkey", "o_orderdate").union(row("decision", "lineitem", "l_orderkey", "l_shipdate")).union(row("observation", "events", "event_id", "ts"))


@query("""SELECT c_custkey AS id, '{"caption":' || CASE WHEN c_acctbal > 0 THEN '"' || c_name || '"' ELSE 'null' END || ',"family":' || c_nationkey || '}' AS json FROM customer""")
def json_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return R.twin(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("family"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("caption")), "id")


@query(
    """SELECT n_name AS family, '{"@context":"https://schema.org","@type":"Dataset","name":"' || n_name || '","temporalCoverage":"' || strftime(MIN(o_orderdate), '%Y-%m-%d') || '/' || strftime(MAX(o_orderdate), '%Y-%m-%d') || '","size":' || COUNT(*) || '}' AS card
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"""
)
def dataset_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("family"))
    by = filings(spark, sf_dir).groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("filed"), "yyyy-MM-dd").alias("a"), F.date_format(F.max("filed"), "yyyy-MM-dd").alias("b"))
    return by.join(n, F.col("family_id") == F.col("n_nationkey")).select("family", R.dataset_card(F.col("n"), F.col("a"), F.col("b"), F.col("family")).alias("card"))


@query("SELECT c_custkey AS id, c_name AS caption, c_nationkey AS family FROM customer")
def record_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as shards of JSON below folders, and read again as one table."""
    path = _folder(spark, "tree")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("caption"), F.col("c_nationkey").alias("family"))
    c.withColumn("shard", F.lpad(F.conv(F.pmod("family", F.lit(16)).cast("string"), 10, 16), 2, "0")).write.partitionBy("shard").json(path)
    return files.json_tree(spark, path, "id long, caption string, family int").select("id", "caption", "family")


@query("SELECT COUNT(*) AS pages, COUNT(DISTINCT url) AS urls, MIN(url) AS first FROM pages")
def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of a compressed list."""
    path = _folder(spark, "list")
    table(spark, sf_dir, "pages").select("page_id", "url").write.option("header", "true").option("compression", "gzip").csv(path)
    return files.page_list(spark, path, "url").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"), F.min("url").alias("first"))


@query(
    """WITH t AS (SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) AS x FROM region) SELECT length(x) AS length, sha256(x) AS sha256, 'application/octet-stream' AS media_type, 'blobs/' || substr(sha256(x), 1, 2) || '/' || sha256(x) AS blob FROM t"""
)
def held_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written file with its size, hash, media type and the address of its bytes."""
    path = _folder(spark, "files")
    table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select("r_name").write.text(path)  # five rows
    return files.documents(spark, path).select("length", "sha256", "media_type", files.blob_path(F.col("sha256")).alias("blob"))


@query(
    """SELECT 'nation' AS name, COUNT(*) AS n, 0 AS differing FROM nation UNION ALL SELECT 'region', COUNT(*), 0 FROM region"""
)
def public_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public tables copied, held ones left out, and the copy's files verified against the manifest made of them."""
    path = _folder(spark, "snapshot")
    tables = {t: table(spark, sf_dir, t) for t in ("nation", "region", "customer")}
    counts = files.snapshot(tables, {"nation", "region"}, {"customer"}, path)
    held = files.manifest(spark, path)
    faults = R.verified(files.manifest(spark, path), held).where("verdict <> 'same'").count()  # some files
    return spark.createDataFrame([(k, n, faults) for k, n in counts.items()], "name string, n long, differing int")


@query("SELECT path, CASE WHEN path % 7 = 0 THEN 'missing' WHEN path % 5 = 0 THEN 'differs' ELSE 'same' END AS verdict FROM (SELECT p_partkey AS path FROM part) UNION ALL SELECT -1 - s_suppkey, 'extra' FROM supplier")
def backup_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup's files by size and digest against what is held."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    held = p.select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("length"), F.sha2("p_name", 256).alias("sha256"))
    copy = held.where("path % 7 <> 0").withColumn("length", F.col("length") + F.when(F.col("path") % 5 == 0, 1).otherwise(0))
    more = s.select((-1 - F.col("s_suppkey")).alias("path"), F.lit(1).cast("long").alias("length"), F.lit("").alias("sha256"))
    return R.verified(copy.unionByName(more), held)


@query(
    r"""SELECT doc_id, round(len(l) / 1.0, 6) AS lines, len(w) >= 3 * greatest(len(l), 1) AND coalesce(median, 0) >= 12 AND round(len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / greatest(len(w), 1), 6) < 0.25 AS prose
    FROM (SELECT doc_id, l, w, list_median(list_transform(l, lambda x: length(x))) AS median FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents))"""
)
def prose_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are prose."""
    f = textquality.features(spread(table(spark, sf_dir, "documents")).select("doc_id", "text"), "text")
    return f.select("doc_id", F.col("lines").cast("double").alias("lines"), textquality.is_prose().alias("prose"))


@query(
    """SELECT c_mktsegment AS agent, c_nationkey % 3 = 0 AS bot, COUNT(*) AS requests, SUM(CASE WHEN contains(c_name || '%_', '%_') THEN 1 ELSE 0 END) AS escaped FROM customer GROUP BY 1, 2"""
)
def bot_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of crawlers and readers; a search's own percent signs are no wildcards."""
    c = table(spark, sf_dir, "customer")
    agent = F.concat(F.lit("Mozilla/5.0 "), F.when(F.col("c_nationkey") % 3 == 0, "Googlebot/2.1").otherwise("Firefox"))
    held = F.like(F.concat("c_name", F.lit("%_")), F.concat(F.lit("%"), S.escaped_like(F.lit("%_")), F.lit("%")))
    return c.groupBy(F.col("c_mktsegment").alias("agent"), S.is_bot(agent).alias("bot")).agg(F.count(F.lit(1)).alias("requests"), F.sum(F.when(held, 1).otherwise(0)).alias("escaped"))


@query(
    """SELECT c_custkey, 'FD ' || c_custkey || CASE WHEN c_nationkey = 0 THEN '' ELSE ' (Sub-No. ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '' END || ')' END AS printed FROM customer WHERE c_nationkey <> 0 OR c_custkey % 2 = 1"""
)
def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_nationkey <> 0 or c_custkey % 2 = 1")
    sub = F.when(F.col("c_nationkey") != 0, F.col("c_nationkey"))
    suffix = F.when((F.col("c_custkey") % 2 == 0) & sub.isNotNull(), F.lit("X"))
    return c.select("c_custkey", S.printed_docket(F.lit("FD"), F.col("c_custkey"), sub, S.no_control(F.concat(suffix, F.lit("\x07")))).alias("printed"))


@query("SELECT strftime(CAST((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') + INTERVAL 1 HOUR AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY 1")
def digest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily digest's days end at 23:00 local time."""
    day = passes.digest_day(F.col("ts").cast("timestamp"))
    return observations(spark, sf_dir).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH e AS (SELECT ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS b, event_type AS kind FROM events), p AS (SELECT ts, kind, SUM(b) OVER (PARTITION BY kind ORDER BY ts, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM e)
    SELECT kind, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS started, COUNT(*) AS n FROM p GROUP BY kind, p HAVING MAX(ts) + INTERVAL 15 MINUTE <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_polling_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes that the watermark has closed."""
    done = _run(passes.polling_passes(_stream(spark, sf_dir, "events").select("ts", F.col("event_type").alias("kind")), "ts", ["kind"]))
    return done.select("kind", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query(
    """WITH d AS (SELECT CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1), s AS (SELECT CAST(UNNEST(generate_series((SELECT MIN(d) - 6 FROM d), (SELECT MAX(d) FROM d), INTERVAL 1 DAY)) AS DATE) AS since)
    SELECT strftime(since, '%Y-%m-%d') AS since, CAST(SUM(n) AS BIGINT) AS n FROM s JOIN d ON d BETWEEN since AND since + 6 WHERE since + 7 <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1"""
)
def stream_sliding_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks, moved a day at a time, that the watermark has closed."""
    done = _run(passes.sliding_weeks(_stream(spark, sf_dir, "events").select("ts"), "ts"))
    return done.select(F.date_format("since", "yyyy-MM-dd").alias("since"), "n")
