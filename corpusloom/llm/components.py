"""Connected components of an edge table, without gathering it anywhere.

``local_forest`` contracts arrays of edges to a star forest; the distributed part
alternates large-star and small-star steps (Kiveris et al., "Connected components in
MapReduce and beyond") until the table of stars stands still.  Every step is an
aggregation with partial sums and a join in which the edges of a hub are dealt out over
salts, so no task gets them all.  A table of at most :data:`FEW` edges is contracted in one
task instead: rounds over it cost the driver some ten plans and stages each, and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import drop_table, split_join, write_table

#: Edges that one task contracts: some hundred KB, whatever the size of the corpus.
FEW = 1 << 14


def _contracted(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[k] and b[k] for all k; the least of a component is its root."""
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with node > root for all nodes that some edge joins; roots are the least of their component."""
    if not len(u):
        return u, v
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = _contracted(np.arange(len(nodes)), back[: len(u)], back[len(u) :])
    keep = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[keep], nodes[root[keep]]


def spanning_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges of the least spanning forest, by (weight, smaller end, larger end); Boruvka's rounds.

    An edge that a part of a graph leaves out is the largest of a circle, so the forests of all parts hold the whole graph's.
    """
    if not len(u):
        return u, v, weight
    low, high = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((high, low, weight))
    low, high, weight = low[order], high[order], weight[order]
    nodes, back = np.unique(np.concatenate([low, high]), return_inverse=True)
    a, b = back[: len(low)], back[len(low) :]
    root, taken, left = np.arange(len(nodes)), np.zeros(len(low), dtype=bool), np.arange(len(low))
    while True:
        ra, rb = root[a[left]], root[b[left]]
        apart = ra != rb
        left, ra, rb = left[apart], ra[apart], rb[apart]
        if not len(left):
            return low[taken], high[taken], weight[taken]
        least = np.full(len(nodes), len(low))
        np.minimum.at(least, ra, left)
        np.minimum.at(least, rb, left)
        chosen = np.unique(least[least < len(low)])
        taken[chosen] = True
        root = _contracted(root, a[chosen], b[chosen])


def _contract(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) as the star forest of all the batches."""
    u, v = [], []
    held = 0
    for batch in found:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
        held += batch.num_rows
        if held > 1 << 20:
            x, y = local_forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [x], [y], len(x) // 2
    if u:
        x, y = local_forest(np.concatenate(u), np.concatenate(v))
        for at in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]), pa.array(y[at : at + (1 << 16)])], names=["u", "v"])


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges u > v, each to the least neighbour of its smaller end, if that has a smaller one."""
    low = edges.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "v")
    sizes = edges.groupBy("v").agg(F.count("*").alias("n"))
    low = sizes.join(low, "v", "left")
    return split_join(edges, low, "v", "u", "n", total).select("u", F.coalesce("low", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node to the least of them.  After a large step a node has as many as forests it is in: no hubs."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    out = edges.join(low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return out.unionAll(low.select("u", F.col("low").alias("v"))).distinct()


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long) but the roots; root is the least node reachable.

    An empty edge table gives no rows.  Rounds grow with the logarithm of the longest chain;
    there are none if the tasks' forests have at most ``few`` edges in all.
    """
    spark = edges.sparkSession
    now, path = write_table(edges.mapInArrow(_contract, "u long, v long"), "edges")
    digest, total = None, now.count()
    if total <= few:
        return now.coalesce(1).mapInArrow(_contract, "u long, v long").select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        nxt, nxt_path = write_table(_small_star(_large_star(now, total)), "stars")
        drop_table(spark, path)
        now, path = nxt, nxt_path
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if seen == digest or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        digest, total = seen, seen[0]
