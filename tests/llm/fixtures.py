"""Awkward documents that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("_n", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("node", T.StringType())]
)
#: Words of a long text: without much repetition.
LONG = "\n".join(" ".join(f"w{(k * 7919 + j * 104729) % 99991}" for j in range(12)) for k in range(2500))
TEXTS = [
    None, "", " ", "\n\n", "one", "two words", LONG, LONG, "Released under the MIT License.", "Ünïcödé ÀÉ words\tand\rmore\x0bof\x0cthem", "The same line of words, said again and again and again by all of them, twenty words or more it has.\nend",
    "The same line of words, said again and again and again by all of them, twenty words or more it has.\nother end", "a" * 5000, "mail me.19@mail5.example.com or +1 (743) 555-3824", "x " * 3000,
]


def awkward(spark: SparkSession) -> DataFrame:
    """Null and repeated ids, repeated rows, columns whose names operators use themselves."""
    rows = [(k, t, "en", k, "s", "n") for k, t in enumerate(TEXTS)]
    rows += [(None, "null id text of some words", None, None, None, None), (3, "another text under a used id", "de", 1, "", ""), (7, LONG, "en", 7, "s", "n")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
