"""Connected components of many small or large graphs at once, by joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.session import cut_lineage


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, comp): the least node that edges (keys, a, b) reach, for every node on an edge; an edge from a node to itself names a lone node.

    Every node keeps a parent, at first itself. In each round a node and its parent take the least grandparent found across the node's edges, and paths are
    shortened to the grandparent, so long chains take a number of rounds that grows with the logarithm of their length. Rounds end when no grandparent changes.
    Each round is saved, so a lost executor costs one round; nothing is collected but the number of changes.
    """
    keys = list(keys)
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    state = both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("_parent")).withColumn("_grand", F.col("_parent"))
    while True:
        near = both.join(state.select(*keys, F.col("node").alias("b"), "_grand"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("_grand").alias("_least"))
        moved = state.join(near, [*keys, "node"])
        taken = moved.select(*keys, "node", F.least("_grand", "_least").alias("_parent")).unionByName(moved.select(*keys, F.col("_parent").alias("node"), F.col("_least").alias("_parent")))
        parents = taken.groupBy(*keys, "node").agg(F.min("_parent").alias("_parent"))
        grand = parents.select(*keys, F.col("node").alias("_parent"), F.col("_parent").alias("_grand"))
        before = state.select(*keys, "node", F.col("_grand").alias("_before"))
        state = cut_lineage(parents.join(grand, [*keys, "_parent"]).join(before, [*keys, "node"]))
        done = state.where("_grand <> _before").isEmpty()
        state = state.drop("_before")
        if done:
            return state.select(*keys, "node", F.col("_grand").alias("comp"))
