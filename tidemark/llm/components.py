"""Connected components of an edge table, by labels that spread and jump, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, materialise

#: Parts of the nodes of one label, where labels are too many to broadcast.
PARTS = 32


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node of its component.

    Each round, a node takes the least label among itself and its neighbours, then the label of that label, so long
    chains shrink by a factor a round. No component meets in one task: neighbours are reduced by partial minima.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        seen = labels.withColumnRenamed("node", "b")
        spread = both.join(seen, "b").select(F.col("a").alias("node"), "label").union(labels.select("node", "label"))
        least = materialise(spread.groupBy("node").agg(F.min("label").alias("label")), "labels")
        # labels that have a smaller one themselves: one row each, so a component of any size is one row here
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root")).where("root < label")
        stale = materialise(least.select("label").distinct().join(root, "label"), "stale-labels")
        after = materialise(_renamed(least, stale), "labels")
        moved = after.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        discard(labels, least, stale)
        labels = after
        if not moved:
            discard(both)
            return labels


def _renamed(labels: DataFrame, stale: DataFrame) -> DataFrame:
    """labels with the roots of stale ones in their place. Many nodes may have one label: few stale ones go to all tasks,
    many are repeated for each of some parts of the nodes."""
    new = F.coalesce("root", "label").alias("label")
    if stale.count() * 16 <= BROADCAST_BYTES:
        return labels.join(F.broadcast(stale), "label", "left").select("node", new)
    parts = labels.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(PARTS)))
    each = stale.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return parts.join(each, ["label", "part"], "left").select("node", new)
