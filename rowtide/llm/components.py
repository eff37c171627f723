"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.storage import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The smallest node that each node of the undirected edges (a, b) reaches: columns node, component.

    Every round is a handful of partially aggregated group-bys and joins on node, and ends in a table in the
    shared folder; only two sums for the convergence test come to the driver. Loops and repeated edges are
    harmless; nodes without edges do not appear; an empty table gives an empty one. Nodes must not be null.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges", small=True)
    state = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node meets the least of the node and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and the node, meet the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        edges = materialize(small, "edges", small=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not converge in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
