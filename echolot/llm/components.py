"""Connected components of a graph of integer ids, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that one task contracts at once.
PIECE = 4_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), each with the lowest node that it reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        i, j = low[x], low[y]
        if (i == j).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))
        while (low != (next_ := low[low])).any():
            low = next_


def _contracted(batches):
    have, held = [], 0

    def batch():
        v, u = stars(*(np.concatenate(x) for x in zip(*have)))
        return u, v

    for b in batches:
        have.append((b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)))
        held += b.num_rows
        if held > PIECE:
            have = [batch()]
            # Where contraction gains nothing more, the piece is passed on as it is.
            if len(have[0][0]) > PIECE // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in have.pop()], ["u", "v"])
            held = sum(len(x[0]) for x in have)
    if have:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in batch()], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """doc_id, component (the lowest id that it reaches) of each end of the edges (a, b).

    First the edges of a ``b`` meet in one task, which contracts what it has to stars;
    so a ``b`` should not have very many.  Then each round points every node, and the
    larger ones of its neighbours, at the lowest node around it (large stars, then
    small stars), so that the number of rounds grows with the logarithm of the
    graph's size.  A round's edges are written to the shared folder: no plan grows
    and no executor's loss matters.  An edge from a node to itself is a component of
    one; nulls must not occur; no edges give no rows.
    """
    ends = edges.repartition("b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    links = stored(ends.mapInArrow(_contracted, "u long, v long").distinct())
    state = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    old = state(links)
    while True:
        # Large star: every larger neighbour of a node points at the least of the node and its neighbours.
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("m").alias("u"), "v").distinct()
        # Small star: a node's smaller neighbours, and it, point at the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        links = stored(small)
        # Done when every edge was there before.
        new = state(links)
        if old == new:
            break
        old = new
    ends = links.select(F.col("v").alias("doc_id"), F.col("u").alias("component"))
    return ends.unionByName(links.select(F.col("u").alias("doc_id"), F.col("u").alias("component"))).groupBy("doc_id").agg(F.min("component").alias("component"))
