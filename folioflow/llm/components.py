"""Connected components of a graph given as edges, by rounds of contraction.

Each round maps every node to the smallest of itself and its neighbours, jumps once along that map, and renames the
edges; edges within a node go. The smallest node of a component always maps to itself, so it names the component in the
end. Neighbourhoods are only ever aggregated (with partial sums on the map side), never collected.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component: its smallest node. Loops are allowed."""
    edges = written(edges.select("a", "b"), "edges")
    both = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = written(both.select("node", F.col("node").alias("component")), "nodes")
    edges_left = written(_tidy(edges), "edges")
    dropped(edges)
    edges = edges_left
    while not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).toDF("node", "other").groupBy("node").agg(F.min("other").alias("other"))
        near = written(near.select("node", F.least("node", "other").alias("to")), "near")
        onward = near.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        near2 = written(near.join(onward, "to").select("node", F.col("onward").alias("to")), "near")
        dropped(near)
        left = near2.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = near2.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        fresh = written(_tidy(edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "edges")
        moved = near2.select(F.col("node").alias("component"), "to")
        named = written(nodes.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "nodes")
        dropped(edges, nodes, near2)
        edges, nodes = fresh, named
    dropped(edges)
    return nodes


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 under the links (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
