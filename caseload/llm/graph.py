"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _flatten(parent: DataFrame) -> DataFrame:
    """Follow (node, up) to the roots: pointer jumping, twice as far each round."""
    while True:
        up = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = materialize(parent.join(up, "up", "left").select(
            "node", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
        moved = jumped.where("moved").limit(1).count()
        drop_table(parent)
        if not moved:
            return jumped
        parent = jumped


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends ``a``, ``b`` of all edges; the label is the smallest node of the component.

    Each round, every component takes the smallest neighbour below itself as parent, the trees
    are flattened, and the edges are contracted to those between different components. Nothing but
    the question whether any edge is left reaches the driver; every round is a written table.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = materialize(nodes.withColumn("label", F.col("node")))
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        parent = _flatten(materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
            "node", F.least("node", "near").alias("up"))))
        up = parent.select(F.col("node").alias("label"), "up")
        new_labels = materialize(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        a = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        b = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        new_edges = materialize(edges.join(a, "a").join(b, "b").where("ra <> rb").select(
            F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        for old in (edges, labels, parent):
            drop_table(old)
        edges, labels = new_edges, new_labels
    drop_table(edges)
    return labels
