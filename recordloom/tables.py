"""Tables by name, and the roles that they play in the record model.

The record model has proceedings (dockets) in two-level families, records entered in them
(filings, decisions), a ledger of observations and pages of text.  Over the star schema a
customer is a docket and its nation the family, an order is a filing, a line is a decision
copy that enters the proceeding of its supplier's nation, an event is an observation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer tasks than there are: a small table of one row group.

    A table that is large enough for every core is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings in their dockets: id, type, date, docket, family."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("filing_id"),
        F.col("o_orderpriority").alias("filing_type"),
        F.to_date("o_orderdate").alias("filed"),
        F.col("c_custkey").alias("docket_id"),
        F.col("c_nationkey").alias("family_id"),
    )


def decision_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of decisions, one for each proceeding that a decision was entered in."""
    line, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    return (
        line.join(s, line["l_suppkey"] == s["s_suppkey"])
        .join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])  # the register of nations: 25 rows
        .select(
            F.col("l_orderkey").alias("decision_id"),
            F.col("l_suppkey").alias("docket_id"),
            F.col("n_nationkey").alias("family_id"),
            F.col("n_name").alias("family"),
            F.col("n_regionkey").alias("region_id"),
            F.col("l_returnflag").alias("decision_type"),
            F.to_date("l_shipdate").alias("served"),
            "l_partkey",
            "l_linenumber",
            "l_extendedprice",
        )
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger: one row for each observation of a key, in the order of ids."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("key"), F.col("event_type").alias("kind"), "ts", "value", F.col("props").alias("payload")
    )
