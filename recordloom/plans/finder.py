"""Queries of the search index: building, upkeep, windows, filters, snippets, names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import scalars as S
from recordloom.operators import index, search
from recordloom.plans.catalogue import query
from recordloom.plans.texts import document_index
from recordloom.storage import shared_dir
from recordloom.tables import table

_TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"


def _bm25(word: str, rows: str = "documents") -> str:
    """SQL: ``r(doc_id, source, lang, score)`` of the rows that hold a word."""
    return f"""t AS (SELECT doc_id, source, lang, {_TOKENS.format("source")} AS a, {_TOKENS.format("text")} AS b FROM {rows}),
    p AS (SELECT doc_id, source, lang, len(a) + len(b) AS dl, 8.0 * len(list_filter(a, lambda x: x = '{word}')) + len(list_filter(b, lambda x: x = '{word}')) AS f FROM t),
    s AS (SELECT COUNT(*) AS n, AVG(dl) AS mean, SUM(CASE WHEN f > 0 THEN 1 ELSE 0 END) AS d FROM p),
    r AS (SELECT doc_id, source, lang, round(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM p, s WHERE f > 0)"""


@query(
    """SELECT 'docket' AS kind, CAST(c_custkey AS VARCHAR) AS ref, '/docket/' || c_custkey AS path, c_name AS title, '' AS body, n_name AS fact, c_mktsegment AS caption FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'party', CAST(s_suppkey AS VARCHAR), '/party/' || s_suppkey, s_name, '', n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'decision', CAST(p_partkey AS VARCHAR), '/decision/' || p_partkey, p_type, p_name, p_brand, NULL FROM part
    UNION ALL SELECT 'filing', CAST(o_orderkey AS VARCHAR), '/filing/' || o_orderkey, o_orderpriority, '', strftime(o_orderdate, '%Y-%m-%d'), c_name FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'comment', conv_id || '-' || turn, '/comment/' || conv_id || '/' || turn, role, text, '', NULL FROM conversations"""
)
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is searched, from five sources, in one shape."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customer, supplier, orders = (table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))

    def shaped(df: DataFrame, kind: str, ref, title, body, fact, caption) -> DataFrame:
        path = F.concat(F.lit(f"/{kind}/"), F.regexp_replace(ref, "-", "/"))
        return df.select(F.lit(kind).alias("kind"), ref.alias("ref"), path.alias("path"), title.alias("title"), body.alias("body"), fact.alias("fact"), caption.cast("string").alias("caption"))

    def text(name: str):
        return F.col(name).cast("string")

    nothing, empty = F.lit(None), F.lit("")
    entered = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    talk = table(spark, sf_dir, "conversations")
    parts = [
        shaped(customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")), "docket", text("c_custkey"), F.col("c_name"), empty, F.col("n_name"), F.col("c_mktsegment")),
        shaped(supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")), "party", text("s_suppkey"), F.col("s_name"), empty, F.col("n_name"), nothing),
        shaped(table(spark, sf_dir, "part"), "decision", text("p_partkey"), F.col("p_type"), F.col("p_name"), F.col("p_brand"), nothing),
        shaped(entered, "filing", text("o_orderkey"), F.col("o_orderpriority"), empty, F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("c_name")),
        shaped(talk, "comment", F.concat_ws("-", "conv_id", "turn"), F.col("role"), F.col("text"), empty, nothing),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents WHERE list_contains({_TOKENS.format("text")}, 'heed')),
    h AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: list_contains({_TOKENS.format("x")}, 'heed')), TRUE) AS p FROM w)
    SELECT doc_id, array_to_string(list_transform(w[greatest(p - 9, 1):greatest(p - 9, 1) + 17], lambda x: CASE WHEN list_contains({_TOKENS.format("x")}, 'heed') THEN '[' || x || ']' ELSE x END), ' ') AS snippet FROM h"""
)
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some words around the first match, of the rows that the index gives only."""
    held = index.ranked(spark, document_index(spark, sf_dir), ["heed"]).select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(held, "doc_id", "left_semi")
    return docs.select("doc_id", search.snippet(F.col("text"), "heed").alias("snippet"))


@query(
    f"""WITH {_bm25("the")}, k AS (SELECT * FROM r ORDER BY score DESC, doc_id LIMIT 50)
    SELECT source, COUNT(*) AS n, MAX(score) AS score, (SELECT COUNT(*) FROM r) > 50 AS cut FROM k GROUP BY source"""
)
def page_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broad word: the best rows only are grouped, and it is said that there were more."""
    hits = index.ranked(spark, document_index(spark, sf_dir), ["the"]).withColumn("score", F.round("score", 6))
    top = index.window(hits, [F.desc("score"), F.asc("doc_id")], 50)
    named = top.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return named.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"), F.first("cut").alias("cut"))


@query(f"WITH {_bm25('heed')} SELECT doc_id, lang, score FROM r WHERE lang IN ('en', 'fr')")
def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered hits keep the scores of the whole index."""
    hits = index.ranked(spark, document_index(spark, sf_dir), ["heed"])
    admitted = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", "lang")
    return hits.join(admitted, "doc_id").select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(
    "SELECT o_orderkey AS filing_id, strftime(o_orderdate, '%Y-%m-%d') AS filed FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25"
)
def browse_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters without words: the newest page."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing_id"), "o_orderdate", "o_orderpriority")
    some = o.where((F.col("o_orderpriority") == "2-HIGH") & F.col("o_orderdate").between("1997-01-01", "1997-12-31"))
    page = some.orderBy(F.desc("o_orderdate"), F.desc("filing_id")).limit(25)
    return page.select("filing_id", F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))


@query(
    """WITH n AS (SELECT 0 AS rank, 'docket' AS kind, c_custkey AS ref, c_name AS name FROM customer UNION ALL SELECT 1, 'party', s_suppkey, s_name FROM supplier)
    SELECT kind, ref, name FROM n WHERE len(list_filter(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+'), lambda x: starts_with(x, '00000001'))) > 0 ORDER BY rank, name LIMIT 8"""
)
def suggested_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows that hold a word so begun, proceedings first."""
    c = table(spark, sf_dir, "customer").select(F.lit(0).alias("rank"), F.lit("docket").alias("kind"), F.col("c_custkey").alias("ref"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.lit(1).alias("rank"), F.lit("party").alias("kind"), F.col("s_suppkey").alias("ref"), F.col("s_name").alias("name"))
    return search.match(c.unionByName(s), "00000001", "name").orderBy("rank", "name").limit(8).select("kind", "ref", "name")


@query(
    f"""WITH d AS (SELECT doc_id, source, lang, CASE WHEN lang = 'fr' THEN 'heed ' || text ELSE text END AS text FROM documents WHERE lang <> 'de'), {_bm25("heed", "d")} SELECT doc_id, score FROM r"""
)
def index_enter_leave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language enters with another text, one leaves; scores are those of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    live = index.SearchIndex(f"{shared_dir(spark)}/recordloom/index-{uuid.uuid4().hex}", "doc_id", (("source", 8), ("text", 1)))
    index.add(live, docs, 0)
    index.changed(live, docs.where("lang = 'fr'").withColumn("text", F.concat(F.lit("heed "), "text")), docs.where("lang = 'de'"), 1)
    return index.ranked(spark, live, ["heed"]).select("doc_id", F.round("score", 6).alias("score"))


@query(
    """WITH n AS (SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') AS norm, MIN(s_suppkey) OVER (PARTITION BY s_nationkey) AS rep FROM supplier),
    r AS (SELECT rep, COUNT(*) AS names FROM n WHERE contains(norm, 'supplier 0000000') GROUP BY rep)
    SELECT rep, names, (SELECT COUNT(*) FROM r) > 5 AS truncated FROM r ORDER BY rep LIMIT 5"""
)
def party_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names that contain some text, one row a component, capped."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", S.normal_name(F.col("s_name")).alias("norm"))
    reps = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("rep"))
    hits = s.where(F.col("norm").contains("supplier 0000000")).join(reps, "s_nationkey").groupBy("rep").agg(F.count(F.lit(1)).alias("names"))
    return index.window(hits, [F.asc("rep")], 5).withColumnRenamed("cut", "truncated")
