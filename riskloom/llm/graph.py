"""Connected components of a link table by hooking and pointer jumping, all in joins and grouped minima."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is the smallest node reachable.

    Each round hooks every node onto its smallest neighbour, jumps pointers until all point at roots, and
    contracts the links to the roots.  A table is written a round, so no lineage grows and the driver only sees
    counts.  Rounds grow with the logarithm of the longest path.  Null ends and self links are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = scratch.save(edges, f"{tag}-edges0")
    nodes = edges.select(F.explode(F.array("hi", "lo")).alias("node")).distinct()
    labels, turn = nodes.withColumn("label", F.col("node")), 0
    while not edges.isEmpty():
        parent = scratch.save(edges.groupBy("hi").agg(F.min("lo").alias("up")), f"{tag}-up{turn}-0")
        jump = 0
        while True:
            nxt = parent.select(F.col("hi").alias("up"), F.col("up").alias("top"))
            step = parent.join(nxt, "up", "left").select("hi", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
            jump += 1
            step = scratch.save(step, f"{tag}-up{turn}-{jump}")
            moved = not step.where("moved").isEmpty()
            parent = step.drop("moved")
            if not moved:
                break
        labels = labels.join(parent.withColumnRenamed("hi", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = scratch.save(labels, f"{tag}-labels{turn}")
        a, b = parent.select(F.col("hi"), F.col("up").alias("ra")), parent.select(F.col("hi").alias("lo"), F.col("up").alias("rb"))
        ends = edges.join(a, "hi", "left").join(b, "lo", "left").select(F.coalesce("ra", "hi").alias("x"), F.coalesce("rb", "lo").alias("y"))
        ends = ends.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()
        turn += 1
        edges = scratch.save(ends, f"{tag}-edges{turn}")
    return labels
