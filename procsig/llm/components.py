"""Distributed union-find: connected components by alternating large-star and small-star steps.

Each step joins edges with the smallest neighbour of one end, an aggregate with map-side combine,
so a vertex with very many edges is pre-aggregated and its join side can be split by Spark's skew
handling. Nothing but a count and a checksum of the edges reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procsig.session import cut_lineage

TASK_EDGES = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges(a, b)`` with a > b. Large star: link larger neighbours to the smallest of all;
    small star: link smaller neighbours and the vertex itself to the smallest of them."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        # b -> m for every smaller neighbour, and a -> m for the vertex itself
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    out = out.where("a > b")
    return out if large else out.distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's own edges: each node with the smallest node it reaches."""
    root: dict = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    kind = None
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
    if root:
        nodes = [x for x in root if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["a", "b"])


def _edges_state(e: DataFrame):
    return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)`` for every node of an edge; root is the smallest node.

    Tasks of at most about ``task_edges`` edges first reduce them to a forest; if one such task
    holds all edges, its forest is the answer, otherwise the star steps go on from the forests.
    """
    e = cut_lineage(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    kind = e.schema["a"].dataType.simpleString()
    state = _edges_state(e)
    tasks = -(-state["n"] // task_edges)
    if tasks:
        e = cut_lineage(e.coalesce(1).mapInArrow(_forest, f"a {kind}, b {kind}") if tasks == 1 else
                        e.repartition(tasks, "b").mapInArrow(_forest, f"a {kind}, b {kind}"))
    state = None
    while tasks > 1:
        now = _edges_state(e)
        if now == state:
            break
        state = now
        e = cut_lineage(_star(_star(e, True), False))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
