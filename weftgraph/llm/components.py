"""Connected components of an edge table by contraction, with nothing collected on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _roots(parent: DataFrame) -> DataFrame:
    """(node, p), a forest as p < node, with p replaced by the root: pointers double until none moves."""
    while True:
        up = parent.select(F.col("node").alias("up"), F.col("p").alias("q"))
        parent = materialize(parent.join(up, F.col("p") == F.col("up"), "left").select("node", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "roots")
        if parent.where("moved").isEmpty():
            return parent.select("node", "p")
        parent = parent.select("node", "p")


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) in any order, without nulls. Returns (node, label), label the smallest node of a component.

    Each round gives every node its smallest smaller neighbour as parent, follows parents to the roots and keeps the
    edges between different roots, so at least half of the nodes of each component go. Parents are found by an
    aggregate that combines before its shuffle; a node with many edges meets a table with one row for it.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    label = None
    while not e.isEmpty():
        root = _roots(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("p")))
        low, high = (root.select(F.col("node").alias(f"{x}_node"), F.col("p").alias(f"{x}_root")) for x in "ab")
        e = e.join(low, F.col("a") == F.col("a_node"), "left").join(high, F.col("b") == F.col("b_node"), "left")
        e = e.select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
        e = materialize(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        if label is None:
            label = root.select("node", F.col("p").alias("label"))
        else:
            step = root.select(F.col("node").alias("was"), "p")
            moved = label.join(step, F.col("label") == F.col("was"), "left").select("node", F.coalesce("p", "label").alias("label"))
            label = moved.unionByName(root.select("node", F.col("p").alias("label")))
            label = materialize(label, "labels")
    if label is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return label.unionByName(label.select(F.col("label").alias("node"), "label").distinct())
