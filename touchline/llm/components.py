"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, component), component the least node reachable; nodes with an edge only.

    Minima come from partial aggregates, and both sides of each join are staged tables, so that
    adaptive execution can split the partition of a hub with many neighbours.
    """
    a, b = F.col("a"), F.col("b")
    edges = staged(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        seen = state
        both = edges.select(a.alias("u"), b.alias("v")).union(edges.select(b, a))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).where("u <> m"), "least")
        large = staged(edges.join(least, b == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
        small = staged(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        rest = large.join(small, "a").where("b <> m").select(b.alias("a"), F.col("m").alias("b"))
        before, edges = edges, staged(rest.union(small.select("a", "m")).distinct(), "edges")
        unstage(before, least, large, small)  # the next round reads only the new edges
