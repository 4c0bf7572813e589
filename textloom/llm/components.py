"""Connected components: trees within tasks first, then alternating large and small stars, each a join on Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize, released

TASK_EDGES = 1 << 20  # edges that a task joins into trees at a time


def join_trees(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges that isn't its tree's least node, and that least node."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(names))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up
    below = np.flatnonzero(low != np.arange(len(names)))
    return names[below], names[low[below]]


def _trees(most: int):
    def run(batches):
        held: list[pa.RecordBatch] = []

        def joined():
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv")
            u, v = join_trees(u, v)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= most:
                out = joined()
                if 2 * out.num_rows > most:  # few of them meet here
                    yield out
                    held.clear()
                else:
                    held[:] = [out]
        if held:
            yield joined()

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link u's larger (large) or smaller neighbours, and u, to the least of them all."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = near.join(least.hint("merge"), "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def component_trees(edges: DataFrame, earlier: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """u, v: each node of the edges (u, v) that isn't its component's least node, and that node; written.

    earlier: the trees of edges seen before, which take part. Edges are joined into trees where they lie,
    and the trees, dealt at random over as many tasks as their number asks for, into larger ones. One
    task's trees are the components; those of several tasks are joined by alternating stars until
    nothing changes.
    """
    edges = edges.where(F.col("u") != F.col("v")).select("u", "v")
    found = materialize(edges.mapInArrow(released(_trees(task_edges)), "u long, v long"), "trees")
    every = found if earlier is None else found.union(earlier)
    tasks = every.count() // task_edges + 1
    now, before = materialize(every.repartition(tasks).mapInArrow(released(_trees(task_edges)), "u long, v long"), "trees"), None
    drop_tables(found)
    while tasks > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not mark[0] or mark == before:
            break
        before = mark
        last, now = now, materialize(_star(_star(now, True), False), "trees")
        drop_tables(last)
    return now


def node_labels(trees: DataFrame) -> DataFrame:
    """node, label (its component's least node) for each node of component_trees()."""
    return trees.select(F.col("u").alias("node"), F.col("v").alias("label")).union(trees.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
