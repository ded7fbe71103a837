"""Connected components of a graph given by its edges.

Edges are counted first. Up to SMALL_GRAPH of them one task joins them in a forest of parents (two
stages in all, a few megabytes). More go through alternating large and small stars: each half step joins a table with the least neighbour of every node. The least neighbours are
written first, so both sides of the join are plain exchanges and a hub's rows can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Edges that one task may take: 16 bytes each, and as much again for the forest.
SMALL_GRAPH = 500_000


def join(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Add edges to a forest of parents, in which every root is the least of its tree."""
    u, v = parent[u], parent[v]
    while len(apart := np.flatnonzero(u != v)):
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while (up := parent[parent] != parent).any():
            parent[up] = parent[parent[up]]
        u, v = parent[u], parent[v]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in rows]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = np.arange(len(nodes))
    join(parent, at[: len(u)], at[len(u) :])
    under = parent != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[under]), pa.array(nodes[parent[under]])], names=["node", "root"])


def _least(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("u").agg(F.min("v").alias("m")))


def _state(rows: DataFrame) -> tuple:
    return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL_GRAPH) -> DataFrame:
    """(node, root) for every node but the roots; root: the least node of its component.

    Nodes are whole numbers; null ends and edges of a node to itself are no edges.
    """
    rows = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    rows = materialize(rows)
    state = _state(rows)
    if state[0] <= small:
        found = materialize(rows.repartition(1).mapInArrow(_forest, "node long, root long"))
        release(rows)
        return found
    while state[0]:
        both = rows.union(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = materialize(large)
        release(rows), release(least)
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        rows = materialize(small)
        release(large), release(least)
        now = _state(rows)
        if now == state:
            break
        state = now
    return rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
