"""Connected components of an undirected edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum and a join on the node, so no neighbour list is ever gathered in one place, and each
round's edges go to the shared folder. The number of rounds grows with the logarithm of the component size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnspark.llm.common import stored


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """pairs (u, v): v is a neighbour of u. Links the neighbours of u to the least of u and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).drop("least")
    joined = pairs.join(least, "u")
    if larger_only:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b) of comparable, non-null nodes -> (node, root): root is the least node of the component.

    Only nodes with an edge to another node are returned. No edges: an empty result."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = _star(both, True)
        edges = stored(_star(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), False), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Indices of edges (i, j) over nodes 0..n-1 that form a spanning forest of them."""
    at, label, chosen = np.arange(len(i)), np.arange(n), []
    while len(at):
        a, b = label[i[at]], label[j[at]]
        apart = a != b
        at, a, b = at[apart], a[apart], b[apart]
        if not len(at):
            break
        high, first = np.unique(np.maximum(a, b), return_index=True)
        chosen.append(at[first])
        parent = np.arange(n)
        parent[high] = np.minimum(a, b)[first]
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
