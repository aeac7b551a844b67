"""Connected components of link tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

MAX_ROUNDS = 60


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of index pairs inside one task; ``parent[i]`` becomes the smallest index of i's set."""
    while len(a):
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``, as ``(node, component)``.

    Rounds of large-star and small-star contraction: every node's neighbours are hung on the smallest one, so
    the number of rounds grows with the logarithm of a component's size and the table never exceeds the
    edges.  The minimum per node is a partial aggregate; only the join that hangs neighbours on it meets hot
    nodes, and that one is open to skew splitting.  Nodes without an edge are absent; null ends are ignored.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        # large star: of u's neighbours and u itself the smallest becomes parent of all larger neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and u itself are hung on the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # done once every node has one parent and no parent has a parent
        deep = after.select(F.col("v").alias("u")).distinct().join(after.select("u"), "u", "left_semi")
        several = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        edges = after
        if deep.union(several).isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
