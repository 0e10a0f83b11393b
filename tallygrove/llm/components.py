"""Connected components of a large graph by contraction.

Each round sends every node to the smallest of its neighbours and itself, twice, and then
merges the edges onto those nodes. The graph shrinks by a constant factor a round. Tables
are written between rounds, and nothing is collected but whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); a component is named by its smallest node."""
    edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "node"), "parents")
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = cut(up.join(top, "up").select("node", "top"), "steps")
        if label is None:
            label = step.select("node", F.col("top").alias("component"))
        else:
            moved = label.join(step.select(F.col("node").alias("component"), "top"), "component", "left")
            label = cut(moved.select("node", F.coalesce("top", "component").alias("component")), "labels")
        for end in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(end), "top"), end).drop(end).withColumnRenamed("top", end)
        edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
