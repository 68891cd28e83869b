"""Queries over scores of readings and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import estimates
from recordloom.plans.catalogue import query, values
from recordloom.tables import table


@query("SELECT round(AVG(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS share, TRUE AS inside FROM labels")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval holds the share; its bounds depend on the draws."""
    out = estimates.bootstrap(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("hit")), "doc_id", "hit")
    return out.select("share", ((F.col("low") <= F.col("share")) & (F.col("share") <= F.col("high")) & (F.col("high") - F.col("low") < 0.3)).alias("inside"))


@query("SELECT * FROM (VALUES (1, 1.0, 1.0, 0), (2, 0.5, 1.0, 1), (3, NULL, NULL, 2)) t(id, recall, precision, invented)")
def reading_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values(spark, "id int, truth string, output string", [(1, "FD 1\tFD 2", "FD 2\tFD 1"), (2, "FD 1\tFD 1", "FD 1\tx"), (3, "a", "b\tc")])
    recall, precision = estimates.item_recall(F.col("truth"), F.col("output"), r"[A-Z]{2} \d+")
    return rows.select("id", recall.alias("recall"), precision.alias("precision"), estimates.invented(F.col("truth"), F.col("output")).alias("invented"))


@query(
    r"""WITH w AS (SELECT doc_id, UNNEST(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents), lex AS (SELECT word FROM w GROUP BY word HAVING COUNT(*) >= 20),
    t AS (SELECT doc_id, UNNEST(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
    s AS (SELECT doc_id, COUNT(*) AS lettered, COUNT(lex.word) AS hits FROM t LEFT JOIN lex ON t.word = lex.word GROUP BY doc_id)
    SELECT doc_id, lettered, hits, round(hits / lettered, 6) AS score FROM s WHERE lettered >= 15 AND hits / lettered < 0.5"""
)
def reread_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recordloom.operators.textquality import lexicon

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lexicon(docs, "doc_id", "text", 20).select("word", F.lit(1).alias("known"))
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    # A document's equal words are counted together before they meet the lexicon.
    counted = found.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")).join(words, "word", "left")
    scores = counted.groupBy("doc_id").agg(F.sum("n").alias("lettered"), F.sum(F.col("n") * F.coalesce("known", F.lit(0))).alias("hits"))
    return estimates.reread(scores, "lettered", "hits").select("doc_id", "lettered", "hits", "score")
