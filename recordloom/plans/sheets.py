"""Queries over sheets, registers and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import sheets as H
from recordloom.plans.catalogue import query, values
from recordloom.tables import filings, observations, table


@query(
    "SELECT * FROM (VALUES (1, 'railroad'), (2, 'government'), (3, 'labor'), (4, 'association'), (5, 'company'), (6, 'individual')) t(id, kind)"
)
def party_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Acme Railroad Co."), (2, "City of Troy"), (3, "Brotherhood of Engineers"), (4, "Rice Growers Association"), (5, "Beta LLC"), (6, "Ann Smith")]
    return values(spark, "id int, name string", rows).select("id", H.party_type(F.col("name")).alias("kind"))


@query("SELECT * FROM (VALUES (1, 'blank'), (2, 'tabular'), (3, 'graphic'), (4, 'text')) t(page, route)")
def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "text", 0.0), (2, "table", 1.0), (2, "text", 9.0), (3, "figure", 5.0), (3, "text", 5.0), (4, "figure", 4.0), (4, "text", 5.0)]
    return H.routed(values(spark, "page int, kind string, area double", rows), ["page"])


@query(
    "SELECT * FROM (VALUES (1, 'read by a person'), (2, 'the document''s own text'), (3, 'machine reading, not compared'), (4, 'machine reading, two agree'), (5, 'machine reading, two differ')) t(id, label)"
)
def reading_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "human", None), (2, "text-layer", None), (3, "ocr", None), (4, "ocr", 0.01), (5, "ocr", 0.4)]
    return values(spark, "id int, channel string, agreement double", rows).select("id", H.reading_label(F.col("channel"), F.col("agreement")).alias("label"))


@query(
    """WITH o AS (SELECT o_custkey AS document, 0 AS r, o_orderkey AS record FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 2, o_orderkey FROM orders)
    SELECT document, CASE r WHEN 0 THEN 'filing' WHEN 1 THEN 'decision' ELSE 'comment' END AS kind, record FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document ORDER BY r, record) AS k FROM o) WHERE k = 1"""
)
def document_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document"), F.col("o_orderkey").alias("rec"), "o_orderstatus")
    return H.owner_of_documents([("filing", o.where("o_orderstatus = 'P'")), ("decision", o.where("o_orderstatus = 'F'")), ("comment", o)], "document", "rec")


@query(
    """WITH c AS (SELECT p_brand AS prefix, p_size % 3 AS kind, COUNT(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT prefix, string_agg(kind || '=' || n, ';' ORDER BY kind || '=' || n) AS types FROM c GROUP BY 1)
    SELECT p_brand AS prefix, COUNT(*) AS dockets, MIN(p_partkey) AS least, MAX(p_partkey) AS most, ANY_VALUE(types) AS types FROM part JOIN t ON p_brand = prefix GROUP BY 1"""
)
def explainer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("prefix"), "p_partkey", (F.col("p_size") % 3).cast("string").alias("kind"))
    return H.explained(p, "prefix", "p_partkey", "kind")


@query(
    """SELECT rep, COUNT(DISTINCT l_orderkey) AS records, COUNT(DISTINCT nation) AS families FROM (SELECT l_orderkey, s_suppkey % 40 AS rep, s_nationkey AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
    GROUP BY rep ORDER BY records DESC, rep LIMIT 10"""
)
def busiest_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "supplier")
    links = line.join(s, line["l_suppkey"] == s["s_suppkey"]).select("l_orderkey", (F.col("s_suppkey") % 40).alias("rep"), "s_nationkey")
    return H.directory(links, "rep", "l_orderkey", "s_nationkey", 10)


@query("SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_custkey ELSE c_nationkey END AS place, COUNT(DISTINCT o_orderkey) AS records FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def party_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "AB").otherwise("FD")  # a market stands for a prefix
    placed = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", H.place_of(own, F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long")).alias("place"))
    return placed.groupBy("place").agg(F.countDistinct("o_orderkey").alias("records"))


@query("SELECT o_custkey AS record, string_agg(f, ',' ORDER BY f) AS files FROM (SELECT DISTINCT o_custkey, o_orderpriority AS f FROM orders UNION SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1")
def attachment_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record"), F.array("o_orderpriority", "o_orderstatus").alias("files"))
    return H.attachments(seen, ["record"], "files").select("record", F.array_join("files", ",").alias("files"))


@query("SELECT * FROM (VALUES ('FD_1', 2), ('AB_2', 1)) t(docket, asked)")
def caption_asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = '[{"name":"items[0][docket]","value":"FD_1"},{"name":"items[0][kind]","value":"x"},{"name":"items[1][docket]","value":"AB_2"},{"name":"items[12][docket]","value":"FD_1"},{"name":"docket","value":"no"}]'
    return H.asked_captions(values(spark, "p string", [(body,)]), F.from_json("p", "array<struct<name: string, value: string>>"))


@query("SELECT * FROM (VALUES (1, '2026-08-03', 1), (2, NULL, 0), (3, NULL, 2), (4, '2026-09-01', 0)) t(id, served, decided)")
def dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "FD 1 (served Aug. 3, 2026)\nDecided:\n July 30, 2026"), (2, "served soon"), (3, "served May 1, 2020 and served May 2, 2020\nDecided: May 1, 2020\n Decided: Sept. 4, 2020"), (4, "served September 1, 2026; (served Sept 1, 2026)")]
    return values(spark, "id int, t string", rows).select("id", F.date_format(H.served_date(F.col("t")), "yyyy-MM-dd").alias("served"), F.size(H.decided_dates(F.col("t"))).alias("decided"))


@query("SELECT * FROM (VALUES ('FD 36873', 'FD_36873'), ('docket no. fd 36873 (sub-no. 1)', 'FD_36873_1'), ('FD_36873_9', 'FD_36873'), ('rail FD 36873', NULL), ('NOR 7', NULL)) t(q, docket)")
def typed_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = values(spark, "q string", [(x,) for x in ("FD 36873", "docket no. fd 36873 (sub-no. 1)", "FD_36873_9", "rail FD 36873", "NOR 7")])
    return H.looked_up(q, "q", values(spark, "docket string", [("FD_36873",), ("FD_36873_1",)]))


@query(
    """SELECT o_custkey AS docket_id, string_agg(o_orderkey, ',' ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS records, strftime(MAX(o_orderdate), '%Y-%m-%d') AS newest FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1"""
)
def register_by_docket(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = filings(spark, sf_dir).where("filing_type = '1-URGENT'")
    return H.register(f, "docket_id", "filed", "filing_id").select("docket_id", "records", F.date_format("newest", "yyyy-MM-dd").alias("newest"))


@query("SELECT event_type AS kind, COUNT(*) AS n, CAST(SUM(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS BIGINT) AS firsts FROM (SELECT event_type, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) GROUP BY 1")
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = H.is_first(observations(spark, sf_dir).select("event_id", "key", "kind"), ["key", "kind"], "event_id")
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("first").alias("firsts"))


@query(
    """SELECT page_id AS url, strftime(seen, '%Y-%m-%d %H:%M:%S') AS last FROM (SELECT page_id, (SELECT MAX(ts) FROM events WHERE user_id = page_id) AS seen FROM pages) ORDER BY seen NULLS FIRST, page_id LIMIT 120"""
)
def recheck_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("url"))
    out = H.longest_unchecked(p, observations(spark, sf_dir).select(F.col("key").alias("url"), "ts"), "url", "ts", 120)
    return out.select("url", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+'), 'ele')")
def accent_free_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(H.folded_letters(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "documents").where(F.array_contains(words, "ele")).select("doc_id")


@query("SELECT 'lang' AS filter, lang AS value FROM documents GROUP BY lang UNION ALL SELECT 'source', source FROM documents GROUP BY source")
def filter_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source")
    return d.select(F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("filter", "value")).distinct()
