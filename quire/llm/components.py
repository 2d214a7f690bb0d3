"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


SMALL = 200_000  # edges: a few MB


def _digest(e: DataFrame):
    """Of a set of distinct edges: how many, and two sums of their hashes. One partial aggregate, nothing is dealt anew."""
    both = [F.sum(F.xxhash64("u", "v", F.lit(i)).cast("decimal(20,0)")) for i in (0, 1)]
    return tuple(e.agg(F.count("*"), *both).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Nulls in either end and self-loops are ignored; repeated edges and an empty table are fine. Both steps take the least
    of a node's neighbours by partial minima and join it to the node's edges. Beyond SMALL edges the minima are written
    first: then both sides of the join are plain exchanges, and the adaptive planner splits the edges of a hub over tasks.
    Each round is written to the shared folder. Rounds end when the count and 128 bits of hashes of the edges stay as they were.
    Raises RuntimeError if `most_rounds` aren't enough (they halve path lengths, so that is beyond 2**60 nodes).
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    known, last = _digest(e), []
    for _ in range(most_rounds):
        held = materialise if known[0] > SMALL else (lambda df, name: df)
        # large star: each neighbour above u moves to the least of u's neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = held(large.where("u <> v").distinct(), "large")
        # small star: each node and its lower neighbours move to the least of them
        low = held(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u <> v").distinct(), "edges", last)
        known, before = _digest(e), known
        if known == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
