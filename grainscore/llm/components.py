"""Connected components by alternating large and small stars, on frames of edges.

Every step keeps the components and moves each vertex nearer to the least
vertex it can reach; steps run until all components are stars, or until no more
than ``ONE_TASK`` edges are left, a bounded rest that one task finishes without further
exchanges.  Minima are summed up before their exchange, and both sides of each
join are plain tables that have been written, so Spark can split a vertex with
very many neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainscore.llm.shared import cut, temporary

ONE_TASK = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) rows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")))
    side = F.col("b") > F.col("a") if large else F.col("b") < F.col("a")
    moved = both.where(side).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("least").alias("b")))
    return cut(moved.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).drop("n"))


def _settled(edges: DataFrame) -> bool:
    """Whether every vertex has one parent and no parent has one itself: all components are stars."""
    parents = edges.select(F.col("b").alias("a")).distinct()
    several = edges.groupBy("a").count().where("count > 1").select("a")
    return edges.select("a").join(parents, "a", "left_semi").unionByName(several).isEmpty()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, the least vertex each can reach) of the graph with edges ``a[i]``-``b[i]``."""
    vertices, places = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = np.split(places, 2)
    label = np.arange(len(vertices))
    while len(u):
        least = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while (label[label] != label).any():
            label = label[label]
        # edges within a component are done
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return vertices, vertices[label]


def _finished(edges: DataFrame) -> DataFrame:
    """(vertex, component) from at most ``ONE_TASK`` edges, in one task."""

    def solve(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in stream]
        if held:
            vertices, least = least_reached(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(least)], names=["vertex", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(solve, "vertex long, component long")


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (long columns a, b), a written table; the component is its least vertex."""
    with temporary(edges.sparkSession) as keep:
        now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        while not (few := now.count() <= ONE_TASK) and not _settled(now):
            with temporary(edges.sparkSession) as keep_step:
                now = keep_step(_star(_star(now, large=True), large=False))
        if few:
            return keep(cut(_finished(now)))
        child = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
        return keep(cut(child.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())))
