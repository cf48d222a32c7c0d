"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import cut, forget, join_hot
from lakeweave.llm.workers import lean

#: links that one task may hold, at 16 bytes each
FEW = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in the links and the smallest id that each can reach: roots hang below smaller roots, and paths are halved."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            return ids, ids[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(p[apart], q[apart]), np.minimum(p[apart], q[apart]))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _at_once(edges: DataFrame) -> DataFrame:
    @lean
    def run(batches):
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
        if parts:
            found = smallest_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id in the links ``a, b``; ids without links are absent.

    Up to FEW different links are joined up in one task, in one job. More are joined up in rounds: each is a large and a
    small star over the links, O(log n) rounds; links live in the shared folder (a round's are deleted once the next are
    written) and nothing but their number reaches the driver. The links of a node that has very many never meet in one
    task (``join_hot``). As soon as FEW are left, they are joined up at once. Null ids and links of a node with itself don't
    count; an empty table gives no rows.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = (edges.count(), None)
    while True:
        if mark[0] <= FEW:
            return _at_once(edges)
        total = 2 * mark[0]
        # large star: every larger neighbour of a node links to the smallest of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("many"))
        large = join_hot(both.where("b > a"), low, ["a"], "many", total).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: smaller neighbours of a node, and the node, link to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("many"))
        met = join_hot(large, low, ["b"], "many", total)
        small = met.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
        after = cut(small.where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(edges)
        if now == mark:
            return after.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(after.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        edges, mark = after, now
