"""Full-text search in a row: tokens, AND matches, snippets; hits capped and grouped.  Ranked search is in ``index``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(?U)[^\W_]+"
K1, B = 1.2, 0.75


def query_tokens(text: str, cut: int = 200) -> tuple[list[str], str | None]:
    """Whole tokens, and the last one as a prefix if it has two characters or more."""
    tokens = [t.lower() for t in re.findall(r"[^\W_]+", text[:cut])]
    if tokens and len(tokens[-1]) >= 2:
        return tokens[:-1], tokens[-1]
    return tokens, None


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def match(docs: DataFrame, text: str, column: str) -> DataFrame:
    """Documents that hold every token of the query, the last as a prefix.

    Each document is judged in its own row: nothing is shuffled.
    """
    whole, prefix = query_tokens(text)
    if not whole and not prefix:
        return docs.limit(0)
    had = tokens(F.col(column))
    hit = F.lit(True)
    for t in whole:
        hit &= F.array_contains(had, t)
    if prefix:
        hit &= F.exists(had, lambda t: t.startswith(prefix))
    return docs.where(hit)


def snippet(text: Column, word: str, width: int = 18) -> Column:
    """Up to ``width`` words around the first match, the match in brackets; null without one."""
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")

    def cut(ws: Column) -> Column:
        marked = F.transform(ws, lambda w: F.when(F.array_contains(tokens(w), word.lower()), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
        at = F.array_position(F.transform(ws, lambda w: F.array_contains(tokens(w), word.lower())), True).cast("int")
        start = F.greatest(at - width // 2, F.lit(1))
        return F.when(at > 0, F.array_join(F.slice(marked, start, F.lit(width)), " "))

    return F.get(F.transform(F.array(words), cut), 0)


def capped(hits: DataFrame, group: str, order: list[Column], per_group: int = 3, most: int = 20) -> DataFrame:
    """The first hits in order, a few for each group; ``truncated`` if there were more in all."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    kept = hits.withColumn("nth", nth).where(F.col("nth") <= per_group)
    # One row more than is shown tells whether something was cut.
    top = kept.orderBy(*order).limit(most + 1)
    place = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` + 1 rows
    return place.withColumn("truncated", F.max("place").over(Window.partitionBy(F.lit(1))) > most).where(F.col("place") <= most)


def grouped(hits: DataFrame, placements: DataFrame, row: str, group: str, tier: str, score: str) -> DataFrame:
    """Matches by proceeding: best tier, best score in it, and how many rows matched."""
    best = F.min(F.struct(F.col(tier).alias("tier"), (-F.col(score)).alias("low")))
    out = hits.join(placements, row).groupBy(group).agg(best.alias("b"), F.countDistinct(row).alias("matches"))
    return out.select(group, F.col("b.tier").alias("tier"), (-F.col("b.low")).alias("score"), "matches")
