"""A search index on disk: postings sorted by token, written once and read by token.

The index of a table is a folder with its postings ``(token, key, f, len, gen)``, its rows
``(key, len, gen)`` and, once rows have left, ``(key, gen)`` of those.  Postings are dealt by
ranges of token and key and sorted, so a query's tokens, and the range of its prefix, are
found by the files' statistics, and a token that most rows hold is in several files.  A
folder is named by a signature of the table's files: it is built anew when they change, and
not otherwise.  Changed rows enter as another generation; older ones of the same key are
passed over.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.search import B, K1, query_tokens, tokens
from recordloom.storage import shared_dir


class SearchIndex(NamedTuple):
    path: str
    key: str
    fields: tuple[tuple[str, int], ...]  # columns and their weights, whole numbers

    def _read(self, spark: SparkSession, part: str) -> DataFrame:
        df = spark.read.parquet(f"{self.path}/{part}")
        if not _exists(spark, f"{self.path}/gone"):
            return df
        gone = spark.read.parquet(f"{self.path}/gone").groupBy(F.col("key").alias("k")).agg(F.max("gen").alias("until"))
        return df.join(gone, (F.col("key") == F.col("k")) & (F.col("gen") < F.col("until")), "left_anti")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "postings")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "rows")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, files = _path(spark, path)
    return files.exists(where)


def signature(docs: DataFrame, *more: object) -> str:
    """Digest of the names, sizes and times of a table's files, and of what else the index depends on."""
    told = [str(m) for m in more]
    for name in sorted(docs.inputFiles()):
        where, files = _path(docs.sparkSession, name)
        status = files.getFileStatus(where)
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:24]


def _counted(docs: DataFrame, key: str, fields: tuple[tuple[str, int], ...], gen: int) -> tuple[DataFrame, DataFrame]:
    """Postings and rows of ``docs``; a row's tokens are sorted and counted in the row."""
    cut = [F.when(F.monotonically_increasing_id() >= 0, tokens(F.col(column))) for column, _ in fields]
    names = [f"t{n}" for n in range(len(fields))]
    df = docs.select(F.col(key).alias("key"), *[c.alias(n) for c, n in zip(cut, names)])
    length = sum((F.size(n) for n in names), F.lit(0))
    # A field's tokens stand as often as it weighs.
    every = F.concat(*[F.flatten(F.array_repeat(n, weight)) for n, (_, weight) in zip(names, fields)])
    df = df.select("key", length.alias("len"), F.when(F.monotonically_increasing_id() >= 0, F.sort_array(every)).alias("s"))
    heads = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1)))
    df = df.select("key", "len", "s", F.when(F.size("s") > 0, heads).otherwise(F.array().cast("array<int>")).alias("h"))
    runs = F.transform("h", lambda i, k: F.struct(F.get("s", i).alias("token"), (F.coalesce(F.get("h", k + 1), F.size("s")) - i).cast("double").alias("f")))
    exploded = df.select("key", "len", F.explode(runs).alias("r")).select("r.token", "key", "r.f", "len", F.lit(gen).alias("gen"))
    return exploded, df.select("key", "len", F.lit(gen).alias("gen"))


def add(index: SearchIndex, docs: DataFrame, gen: int) -> None:
    postings, rows = _counted(docs, index.key, index.fields, gen)
    rows.write.mode("append").parquet(f"{index.path}/rows")
    dealt = postings.repartitionByRange("token", "key").sortWithinPartitions("token", "key")
    dealt.write.mode("append").option("parquet.block.size", 16 << 20).parquet(f"{index.path}/postings")


def opened(docs: DataFrame, key: str, fields: dict[str, int], name: str = "") -> SearchIndex:
    """The index of a table's files, built if there is none of them as they are."""
    spark, own = docs.sparkSession, tuple(fields.items())
    index = SearchIndex(f"{shared_dir(spark)}/recordloom/index-{signature(docs, key, own, name)}", key, own)
    if not _exists(spark, f"{index.path}/postings/_SUCCESS"):
        if _exists(spark, index.path):  # left unfinished
            where, files = _path(spark, index.path)
            files.delete(where, True)
        add(index, docs, 0)
    return index


def changed(index: SearchIndex, entering: DataFrame | None, leaving: DataFrame | None, gen: int) -> None:
    """Rows that enter (for an older row of their key) and keys ``leaving`` that leave, as generation ``gen``."""
    keys = [df.select(F.col(index.key).alias("key")) for df in (entering, leaving) if df is not None]
    out = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
    out.select("key", F.lit(gen).alias("gen")).write.mode("append").parquet(f"{index.path}/gone")
    if entering is not None:
        add(index, entering, gen)


def match(spark: SparkSession, index: SearchIndex, text: str) -> DataFrame:
    """Keys of the rows that hold every token of the query, the last as a prefix."""
    whole, prefix = query_tokens(text)
    token = F.col("token")
    if not whole and not prefix:
        return index.rows(spark).select(F.col("key").alias(index.key)).limit(0)
    asked = [token == w for w in dict.fromkeys(whole)] + ([token.startswith(prefix)] if prefix else [])
    some = asked[0]
    for a in asked[1:]:
        some |= a
    held = index.postings(spark).where(some).groupBy("key").agg(*[F.max(a).alias(f"a{n}") for n, a in enumerate(asked)])
    for n in range(len(asked)):
        held = held.where(f"a{n}")
    return held.select(F.col("key").alias(index.key))


def ranked(spark: SparkSession, index: SearchIndex, words: list[str]) -> DataFrame:
    """``(key, score)`` of rows that hold all words, by Okapi BM25 over weighted fields.

    Frequencies and the mean length are those of the whole index, whatever is filtered later.
    """
    words = [w.lower() for w in dict.fromkeys(words)]
    held = index.postings(spark).where(F.col("token").isin(words))
    per = held.groupBy("key").agg(F.first("len").alias("len"), *[F.coalesce(F.sum(F.when(F.col("token") == w, F.col("f"))), F.lit(0.0)).alias(f"f{n}") for n, w in enumerate(words)])
    counts = held.agg(*[F.count_if(F.col("token") == w).alias(f"d{n}") for n, w in enumerate(words)])
    whole = index.rows(spark).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    stats = F.broadcast(counts.join(whole))  # one row of each
    for n in range(len(words)):
        per = per.where(f"f{n} > 0")

    def part(n: int) -> Column:
        df, f = F.col(f"d{n}"), F.col(f"f{n}")
        return F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    return per.join(stats).select(F.col("key").alias(index.key), sum((part(n) for n in range(len(words))), F.lit(0.0)).alias("score"))


def window(hits: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` hits, and ``cut``: whether there were more."""
    top = hits.orderBy(*order).limit(most + 1)  # one more than are shown
    n = top.agg((F.count(F.lit(1)) > most).alias("cut"))
    return top.orderBy(*order).limit(most).join(F.broadcast(n))  # one row
