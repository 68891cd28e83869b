"""HTML fragments and the envelopes that carry them, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities that cells are unescaped from.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
ENVELOPE = "success boolean, data struct<rows: string, total: long, message: string>, _corrupt_record string"
NOTHING = r"(?i)\bno (?:\w+ ){0,4}(?:results|records|entries)\b"


def clean(cell: Column) -> Column:
    """A cell's text: no tags, entities as characters, white space collapsed."""
    out = F.regexp_replace(cell, r"(?s)<[^>]*>", " ")
    for name, character in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def envelope(df: DataFrame, column: str) -> DataFrame:
    """``ok``, ``rows``, ``total`` and ``problem`` of a JSON envelope; what isn't one is a problem, not an error."""
    read = df.withColumn("_e", F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    e = F.col("_e")
    problem = (
        F.when(e.isNull() | e["_corrupt_record"].isNotNull() | e["success"].isNull(), "not an envelope")
        .when(~e["success"], "failed")
        .when(e["data"]["rows"].isNull(), F.when(F.coalesce(e["data"]["message"].rlike(NOTHING), F.lit(False)), "nothing").otherwise("no rows"))
    )
    return read.select(*df.columns, problem.isNull().alias("ok"), e["data"]["rows"].alias("rows"), e["data"]["total"].alias("total"), problem.alias("problem"))


def rows(df: DataFrame, column: str) -> DataFrame:
    """One row for each ``<tr>`` with cells: ``row_no``, raw ``cells``, their ``texts``, the anchor's id and link."""
    found = df.withColumn("_tr", F.explode(F.transform(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), lambda x, i: F.struct(i.alias("i"), x.alias("x")))))
    cells = F.regexp_extract_all(F.col("_tr.x"), F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
    out = found.select(*df.columns, F.col("_tr.i").alias("row_no"), cells.alias("cells"), F.nullif(F.regexp_extract("_tr.x", r'data-stb-id="([^"]*)"', 1), F.lit("")).alias("anchor"), F.nullif(F.regexp_extract("_tr.x", r'href="([^"]*)"', 1), F.lit("")).alias("href"))
    return out.where(F.size("cells") > 0).withColumn("texts", F.transform("cells", clean))


def parsed(df: DataFrame, spec: dict[str, int], cells: int, corroborate: tuple[int, int]) -> DataFrame:
    """Columns by a table's spec from :func:`rows`, and ``skipped`` for rows that can't be trusted.

    ``corroborate`` is (part of the anchor's id, cell): both must name the same thing.
    """
    part, cell = corroborate
    printed = F.regexp_replace(F.get("texts", F.lit(cell)), r"[\s-]+", "_")
    bad = (F.size("texts") != cells) | ~F.get(F.split("anchor", r"\|"), F.lit(part)).eqNullSafe(printed)
    return df.select(*[c for c in df.columns if c not in ("cells", "texts")], *[F.get("texts", F.lit(k)).alias(n) for n, k in spec.items()], bad.alias("skipped"))


def links(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Anchors of a page with their target and text."""
    tags = F.regexp_extract_all(F.col(column), F.lit(r'(?is)<a\b[^>]*\bhref="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    found = pages.select(key, F.posexplode(tags).alias("nth", "tag"))
    return found.select(key, "nth", F.regexp_extract("tag", r'(?is)\bhref="([^"]*)"', 1).alias("href"), clean(F.col("tag")).alias("text"))
