"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id that has an edge, with the least id that it is connected to.

    ``edges``: (a bigint, b bigint).  The number of rounds grows with the logarithm of the longest
    path; each node's least neighbour is found by a partial minimum and joined back, so that a hub's edges are
    spread over tasks.  Each round is written to the shared folder."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.join(near, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        # what hangs below a node goes to the node's least neighbour above it
        small = least.select(F.col("m").alias("a"), "b").union(large.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        after = cut(small)
        moved = after.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(after, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if moved:
            break
    root = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("root"))
    return root.union(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct().join(root.select("id"), "id", "left_anti"))
