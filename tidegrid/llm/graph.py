"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b).

    In every round each node takes its smallest neighbour as parent and then that one's parent, and edges are redrawn
    between parents; those inside a component vanish, so both the edges and the paths shrink until none is left.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up")))
        further = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = checkpointed(parent.join(further, "up").select("node", F.col("top").alias("component")))
        own, other = (parent.select(F.col("node").alias(c), F.col("component").alias(f"{c}_top")) for c in ("a", "b"))
        moved = edges.join(own, "a").join(other, "b").where("a_top <> b_top")
        edges = checkpointed(moved.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct())
        labels = parent if labels is None else checkpointed(relabelled(labels, parent))
    return labels


def relabelled(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """labels (node, component) after components have merged as in merged (node, component)."""
    moved = merged.select(F.col("node").alias("component"), F.col("component").alias("moved"))
    return labels.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component"))
