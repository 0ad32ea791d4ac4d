"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.lineage import cut, release


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of `edges` (a, b): node, component.

    Each round every vertex points to the least of its neighbours and itself, pointers are doubled
    once, and the graph is contracted along them; the least vertex of a component always points to
    itself, so it is what remains. Rounds follow the logarithm of the longest path. A vertex with
    very many edges is one row per map task in the minimum, and its joins split.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p"))
        once = cut(least)
        above = once.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = cut(once.join(above, "p").select("v", F.col("pp").alias("p")))
        step = labels.join(parent, F.col("component") == F.col("v"), "left")
        new_labels = cut(step.select("node", F.coalesce("p", "component").alias("component")))
        ends = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(
            parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b"
        )
        contracted = cut(
            ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        release(edges, labels, once, parent)
        edges, labels = contracted, new_labels
    return labels
