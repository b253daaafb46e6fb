"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.llm.staging import materialise


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with ``m``, the least b of their a.

    The least is counted by parts. A node with very many edges is dealt to parts, each of which gets a copy of its least
    neighbour, so no task gets all its edges.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    return skew.join(edges, low.select("a", "m"), ["a"], skew.large_keys(low, ["a"], total))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) can reach; nodes are of any type that has an order.

    Alternates two steps until nothing changes. Each replaces a node's edges to larger
    (then to smaller) neighbours by edges to the smallest neighbour; the number of edges
    never grows and the number of rounds is about the logarithm of the longest path.
    No edges give an empty table; loops and repeated edges are harmless; a null end drops the edge.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, seen = materialise(e), None
    while True:
        sums = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a").cast("long"))).first()
        if sums == seen or not sums["n"]:
            break
        seen = sums
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = with_least(both, 2 * sums["n"]).where("b > a")
        large = materialise(low.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct())
        small = with_least(large, sums["n"]).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = materialise(small.where("a <> b").distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
