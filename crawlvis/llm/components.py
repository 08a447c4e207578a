"""Connected components of a graph held in tables, by hooking to the least neighbour and contraction.

Each round gives every node its least neighbour as parent, jumps from parent to parent until every
node points at a root, and replaces edges by those between roots. Edges shrink from round to round,
and the rounds grow with the logarithm of a component's size. Joins read written tables on either
side, so that a node with very many edges, or a root of very many nodes, is split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlvis.llm.store import dropped, written


def _roots(edges: DataFrame) -> DataFrame:
    """node, root: the root of each node of ``edges`` when all nodes hang on their least neighbour, if that is less than they."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.min("v").alias("near"))
    roots = written(near.select(F.col("u").alias("node"), F.least("u", "near").alias("root")), "roots")
    while True:
        over = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        dropped(roots)
        roots = moved
        if not moved.where("moved").take(1):
            return roots


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node of ``edges`` (u, v): label is the least node of its component.

    Nodes may be of any type that has an order. Repeated edges and those from a node to itself do no harm.
    """
    edges = written(edges.select("u", "v").distinct(), "edges")
    labels = None
    while labels is None or edges.take(1):
        roots = _roots(edges)
        if labels is None:
            labels = written(roots.select("node", F.col("root").alias("label")), "labels")
        else:
            over = roots.select(F.col("node").alias("label"), F.col("root").alias("next"))
            old, labels = labels, written(labels.join(over, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
            dropped(old)
        left = edges.join(roots.select(F.col("node").alias("u"), F.col("root").alias("a")), "u")
        between = left.join(roots.select(F.col("node").alias("v"), F.col("root").alias("b")), "v").where("a != b")
        old, edges = edges, written(between.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        dropped(old, roots)
    dropped(edges)
    return labels
