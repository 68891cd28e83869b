"""Queries over directed relations and families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators import graph
from recordloom.plans.catalogue import query, values
from recordloom.tables import table


@query("SELECT * FROM (VALUES (1, 2, 1), (1, 3, 2), (1, 4, 2), (1, 5, 3), (2, 3, 1), (2, 4, 1), (2, 5, 2), (9, 8, 1)) t(origin, party, steps)")
def successor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = values(spark, "a int, b int", [(1, 2), (2, 3), (2, 4), (3, 5), (4, 5), (5, 2), (9, 8), (8, 9)])
    # Node 2 is on a cycle with 3 and 5; nobody succeeds itself.
    found = graph.successors(edges, values(spark, "party int", [(1,), (2,), (9,)]))
    return found.where("origin <> party")


@query(
    """SELECT DISTINCT LEAST(s_nationkey, 20) AS rep_a, c_nationkey AS rep_b, 'served' AS rel_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE LEAST(s_nationkey, 20) <> c_nationkey"""
)
def relations_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rel = line.join(o, line["l_orderkey"] == o["o_orderkey"]).select(F.col("l_suppkey").alias("a"), (F.col("o_custkey") + 1_000_000).alias("b"), F.lit("served").alias("rel_type"))
    reps = s.select(F.col("s_suppkey").alias("party_id"), F.least("s_nationkey", F.lit(20)).alias("rep")).union(c.select((F.col("c_custkey") + 1_000_000).alias("party_id"), F.col("c_nationkey").alias("rep")))
    return graph.outside(rel, reps)


@query("SELECT * FROM (VALUES (1, 10), (1, 11), (1, 12), (2, 12), (2, 10), (3, 30)) t(work_id, docket_id)")
def family_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    dockets = values(spark, "docket_id int, parent_id int", [(10, None), (11, 10), (12, 10), (30, None)])
    return graph.family_closure(dockets, values(spark, "work_id int, docket_id int", [(1, 10), (2, 12), (3, 30)]))
