"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations (combined before the shuffle) and two joins.  The joins'
smaller side is written to the shared folder first, so both sides of a join are plain
exchanges and a node with very many edges can be split over tasks at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.storage import drop, save


def _digest(edges: DataFrame) -> tuple:
    """Count and an order-free sum of hashes: equal when a round changed nothing."""
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for every node of an edge; root is its component's least node.

    Edges are undirected; repeated edges and self-loops are allowed, and edges with a
    null end are ignored.  A node that is only in self-loops is its own root.  An empty
    edge table gives no rows.  Nodes may be of any orderable type.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )
    given = save(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = given
    seen = _digest(now)
    while seen[0]:
        ways = now.where("u != v")
        ways = ways.unionByName(ways.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = save(ways.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("k"), F.least("u", "v").alias("m")), "low")
        large = save(
            ways.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        under = save(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "under")
        small = large.join(under, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        after = save(small.select("e.u", "e.v").where("u != v").distinct(), "star")
        told = _digest(after)
        for old in (low, large, under) + ((now,) if now is not given else ()):
            drop(old)
        now = after
        if told == seen:
            break
        seen = told
    # After convergence each node has one edge to its root.
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root")) if seen[0] else now.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    roots = given.select(F.col("u").alias("node")).union(given.select(F.col("v").alias("node"))).distinct()
    return roots.join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
