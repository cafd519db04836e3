"""Connected components of a graph given by edges, as Spark joins.

Each task first replaces the edges it reads by links to the smallest node they
connect.  Up to ``EDGES`` of these are joined by one more task.  For more of them,
large-star and small-star steps in turn: each links the neighbours of a node
to the smallest of them, which keeps components and shortens paths.  It ends
when every node points straight at the smallest node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Edges that one task joins, or replaces at a time.
EDGES = 1 << 20


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        x, y = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        x, y = x[x != y], y[x != y]
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _joined(edges: DataFrame, loops: bool = False, most: int = EDGES) -> DataFrame:
    """Edges (a, b) of a task, about ``most`` at a time, as links of nodes a to the smallest b; with ``loops`` that one's own too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            a, b = roots_of(*(np.concatenate([h[i] for h in held]) for i in range(2)))
            use = np.ones(len(a), bool) if loops else a > b
            return pa.RecordBatch.from_arrays([pa.array(a[use], pa.int64()), pa.array(b[use], pa.int64())], names=["a", "b"])

        held, size = [], 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(2)])
            size += batch.num_rows
            if size >= most and not loops:
                yield links()
                held, size = [], 0
        if held:
            yield links()

    return edges.mapInArrow(run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step.  ``edges`` has a, b with a > b; so has the result."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(
            least.filter("a > m").select("a", F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for each node that has an edge.

    Edges may be repeated, in either direction; loops count for nothing, so a
    node with only a loop is left out.
    """
    pairs = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).filter("a > b")
    now = stored(_joined(pairs), "edges")
    if now.count() <= EDGES:
        return _joined(now.repartition(1), loops=True).select(F.col("a").alias("node"), F.col("b").alias("root"))
    now, before = stored(now.distinct(), "edges"), None
    while True:
        nxt = stored(_star(_star(now, large=True), large=False), "edges")
        sign = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(edges.sparkSession, now)
        now = nxt
        if sign == before:
            break
        before = sign
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
