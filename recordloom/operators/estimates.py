"""Estimates from samples, and scores of readings against truths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.textquality import common_items


def bootstrap(df: DataFrame, key: str, hit: str, rounds: int = 200, seed: int = 7) -> DataFrame:
    """The share of hits and its 95 % interval over resampled rounds.

    A round draws each row a Poisson(1) number of times, which needs no row to meet another;
    rounds are added up within a task before the shuffle, so a task sends a row for each.
    """
    # Poisson(1) by inversion of a uniform that is a hash of the row's key and the round.
    u = (F.pmod(F.xxhash64(F.col(key), F.col("_round") + seed), F.lit(1_000_000)) + 0.5) / 1e6
    times = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.996340, 4).otherwise(5)
    drawn = df.select(key, F.col(hit).cast("int").alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("_round")).withColumn("_t", times)
    shares = drawn.groupBy("_round").agg((F.sum(F.col("_t") * F.col("_h")) / F.greatest(F.sum("_t"), F.lit(1))).alias("_s"))
    bounds = shares.agg(F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975))).alias("_b"))
    whole = df.agg(F.round(F.avg(F.col(hit).cast("int")), 6).alias("share"))
    return whole.join(F.broadcast(bounds), F.lit(True)).select("share", F.get("_b", F.lit(0)).alias("low"), F.get("_b", F.lit(1)).alias("high"))  # one row each


def item_recall(truth: Column, output: Column, pattern: str) -> tuple[Column, Column]:
    """Recall and precision of what a pattern finds in two readings, as multisets."""
    a, b = F.regexp_extract_all(truth, F.lit(pattern), F.lit(0)), F.regexp_extract_all(output, F.lit(pattern), F.lit(0))
    both = common_items(a, b)
    return both / F.nullif(F.size(a), F.lit(0)), both / F.nullif(F.size(b), F.lit(0))


def invented(truth: Column, output: Column, sep: str = "\t") -> Column:
    """Cells of a table reading that its truth doesn't have."""
    def cells(t: Column) -> Column:
        return F.filter(F.transform(F.split(t, rf"[{sep}\n]"), lambda x: F.trim(x)), lambda x: x != "")

    return F.size(cells(output)) - common_items(cells(output), cells(truth))


def reread(scores: DataFrame, lettered: str, hits: str, least: int = 15, cut: float = 0.5) -> DataFrame:
    """Pages to read again: enough lettered tokens, few of them words; the worst first."""
    score = F.col(hits) / F.col(lettered)
    return scores.where((F.col(lettered) >= least) & (score < cut)).withColumn("score", F.round(score, 6))
