"""Directed relations between parties, walked in the direction that they declare."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.storage import drop, save


def successors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(origin, party, steps)``: what each party became, over edges ``(a, b)`` read as a before b.

    Each (origin, party) once at its fewest steps, so cycles end.  Chains, whose parties became one other
    each, are walked by doubling: after a step's jumps those of two, four, eight steps, so a chain takes as many
    rounds as its length has binary digits.  A party that became several is one round for all of them.
    """
    edges = save(edges.select("a", "b").distinct(), "edges")
    alone = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
    jumps = [save(alone.where("n = 1").select("a", "b"), "jumps")]  # by 1, 2, 4, ... steps, over parties that became one other
    forks = save(edges.join(alone.where("n > 1").select("a"), "a", "left_semi"), "forks")
    forked = not forks.isEmpty()

    def ahead(front: DataFrame, ways: DataFrame, steps: int) -> DataFrame:
        return front.join(ways, front["party"] == ways["a"]).select("origin", F.col("b").alias("party"), (F.col("steps") + steps).alias("steps"))

    def better(found: DataFrame, than: DataFrame) -> DataFrame:
        """Of what was found, the least steps of each pair, where they are fewer than those known."""
        least = found.groupBy("origin", "party").agg(F.min("steps").alias("steps"))
        known = than.select(F.col("origin").alias("o"), F.col("party").alias("p"), F.col("steps").alias("s"))
        met = least.join(known, F.col("origin").eqNullSafe(F.col("o")) & F.col("party").eqNullSafe(F.col("p")), "left")
        return met.where("s is null or steps < s").select("origin", "party", "steps")

    def merged(one: DataFrame, other: DataFrame) -> DataFrame:
        return save(one.unionByName(other).groupBy("origin", "party").agg(F.min("steps").alias("steps")), "successors")

    seen = fresh = save(start.select(F.col("party").alias("origin"), "party", F.lit(0).alias("steps")).distinct(), "successors")
    while True:
        # Along the chains from what is new: after round k all that is fewer than 2 ** (k + 1) steps ahead.
        for k in count():
            if k == len(jumps):
                far = jumps[-1].select("a", F.col("b").alias("mid")).join(jumps[-1].select(F.col("a").alias("of"), "b"), F.col("mid") == F.col("of"))
                jumps.append(save(far.select("a", "b"), "jumps"))
            found = save(better(ahead(fresh, jumps[k], 2**k), seen), "front")
            if found.isEmpty():
                break
            grown, front = merged(seen, found), merged(fresh, found)
            for old in (found, seen) + ((fresh,) if fresh is not seen else ()):
                drop(old)
            seen, fresh = grown, front
        if not forked:
            break
        found = save(better(ahead(fresh, forks, 1), seen), "front")
        if found.isEmpty():
            break
        grown = merged(seen, found)
        for old in (seen,) + ((fresh,) if fresh is not seen else ()):
            drop(old)
        seen, fresh = grown, found
    return seen.where("steps > 0")


def outside(relations: DataFrame, reps: DataFrame) -> DataFrame:
    """Directed relations whose ends are different components, by representative."""
    a, b = reps.select(F.col("party_id").alias("a"), F.col("rep").alias("rep_a")), reps.select(F.col("party_id").alias("b"), F.col("rep").alias("rep_b"))
    return relations.join(a, "a").join(b, "b").where("rep_a <> rep_b").select("rep_a", "rep_b", "rel_type").distinct()


def family_closure(dockets: DataFrame, works: DataFrame) -> DataFrame:
    """Each work's dockets: its own, their children and their parents, each once."""
    own = works.select("work_id", "docket_id")
    kids = works.join(dockets.select(F.col("docket_id").alias("k"), F.col("parent_id")), F.col("docket_id") == F.col("parent_id")).select("work_id", F.col("k").alias("docket_id"))
    up = works.join(dockets.where("parent_id is not null").select(F.col("docket_id").alias("c"), F.col("parent_id").alias("p")), F.col("docket_id") == F.col("c")).select("work_id", F.col("p").alias("docket_id"))
    return own.union(kids).union(up).distinct()
