"""File sources and sinks: marked text, media types, snapshots with a guard, manifests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a column so named never leaves in a snapshot.
SUSPECT = re.compile(r"email|token|secret|_enc$|recipient|address")
UNMARKED_LIMIT = 6000


def json_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every JSON record under a folder tree, with the file it came from."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root).withColumn("file", F.input_file_name())


def page_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One column of a CSV file, gzipped or not."""
    return spark.read.option("header", "true").csv(path).select(F.col(column))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Files with their content's hash and media type."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), media_type(F.col("content"), F.col("path")).alias("media_type"))


def media_type(content: Column, path: Column) -> Column:
    """By a file's first bytes; the extension only tells zip containers apart."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("25504446"), "application/pdf")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("49492A00") | head.startswith("4D4D002A"), "image/tiff")
        .when(head.startswith("504B0304") & path.endswith(".docx"), "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
        .when(head.startswith("504B0304") & path.endswith(".xlsx"), "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
        .when(head.startswith("504B0304"), "application/zip")
        .otherwise("application/octet-stream")
    )


def blob_path(sha256: Column) -> Column:
    return F.concat_ws("/", F.lit("blobs"), F.substring(sha256, 1, 2), sha256)


def marked_pages(df: DataFrame, key: str, column: str) -> DataFrame:
    """Pages of a text marked ``===== page N =====``; an unmarked text is page 1 unless it is too long."""
    mark = r"(?m)^===== page (\d+) =====\n?"
    numbers = F.regexp_extract_all(F.col(column), F.lit(mark), F.lit(1))
    parts = F.slice(F.split(F.col(column), mark), 2, 1_000_000_000)
    marked = df.where(F.size(numbers) > 0).select(key, F.explode(F.arrays_zip(numbers.alias("n"), parts.alias("t"))).alias("p"))
    plain = df.where((F.size(numbers) == 0) & (F.length(column) <= UNMARKED_LIMIT)).select(key, F.lit(1).cast("long").alias("page"), F.col(column).alias("text"))
    return marked.select(key, F.col("p.n").cast("long").alias("page"), F.col("p.t").alias("text")).unionByName(plain)


def snapshot(tables: dict[str, DataFrame], allowed: set[str], held: set[str], path: str) -> dict[str, int]:
    """Write the allowed tables; refuse any other that isn't held back, and any suspect column."""
    unknown = set(tables) - allowed - held
    if unknown:
        raise ValueError(f"tables neither public nor held back: {sorted(unknown)}")
    suspect = [f"{t}.{c}" for t in sorted(allowed & set(tables)) for c in tables[t].columns if SUSPECT.search(c)]
    if suspect:
        raise ValueError(f"columns that may not leave: {suspect}")
    counts = {}
    for name in sorted(allowed & set(tables)):
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        counts[name] = tables[name].sparkSession.read.parquet(f"{path}/{name}").count()
    return counts


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a snapshot with size and hash."""
    return documents(spark, path).select("path", "length", "sha256")


def sitemap(df: DataFrame, order: str, size: int) -> DataFrame:
    """Sections of at most ``size`` rows: their number, first and last key.

    Ranks come from counts of key ranges, so no task sorts all keys.
    """
    spark = df.sparkSession
    keyed = df.select(order).repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id())
    from recordloom.storage import save

    keyed = save(keyed, "sitemap")
    counts = sorted((r["_p"], r["n"], r["k"]) for r in keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("k")).collect())
    starts, at = [], 0
    for p, n, k in counts:
        starts.append((p, at, k))
        at += n
    first = F.broadcast(spark.createDataFrame(starts, "_p int, _start long, _first long"))  # a row for each partition
    rank = F.col("_start") + F.col("_k") - F.col("_first")
    return keyed.join(first, "_p").groupBy((F.floor(rank / size) + 1).cast("long").alias("section")).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
