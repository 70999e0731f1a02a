"""Connected components of an edge table by contraction, without a driver copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Scratch, release_shuffles


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges``, as a table of ``scratch``.

    Each round every node points at its smallest neighbour, pointers are followed
    once more, and the edges are rewritten between what remains; nodes that
    pointed elsewhere are gone from the edges, which shrink by a factor. The
    pointers of all rounds are applied in turn, and a round's tables are deleted
    when the next one's are written. A node's neighbours are reduced by partial
    aggregation, so a hot node costs one row per task.
    """
    stage = scratch.stage
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges = stage(edges, "cc-edges")
    release_shuffles(scratch.spark)  # what the edges were made from may be large
    labels = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "cc-nodes")
    while not edges.isEmpty():
        point = edges.groupBy("a").agg(F.min("b").alias("to"))
        further = point.select(F.col("a").alias("to"), F.col("to").alias("beyond"))
        point = stage(point.join(further, "to", "left").select("a", F.coalesce("beyond", "to").alias("to")), "cc-point")
        pa, pb = point.select("a", F.col("to").alias("na")), point.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        moved = edges.join(pa, "a").join(pb, "b", "left").select(F.col("na"), F.coalesce("nb", "b").alias("nb"), F.col("a"))
        # the pointer itself is an edge too: what is pointed at from two sides stays joined
        rest = moved.select(F.greatest("na", "nb").alias("a"), F.least("na", "nb").alias("b")).where("a <> b").distinct()
        hop = point.select(F.col("a").alias("component"), "to")
        named = labels.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        done = edges, labels, point
        edges, labels = stage(rest, "cc-edges"), stage(named, "cc-labels")
        scratch.drop(*done)
    scratch.drop(edges)
    return labels
