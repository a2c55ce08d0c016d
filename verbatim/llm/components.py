"""Connected components of a graph of links, without bringing the graph to one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop

#: Links that one task holds at once (16 MB); a graph with more than these is brought together in rounds.
TOGETHER = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node reachable from each) of all nodes that the links name."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while len(a):
        # The larger root of each link goes below the smaller one; then each node is told its root.
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        while (least[least] != least).any():
            least = least[least]
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[least]


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v), u > v, that connect what a task's links connect, each node with one other; TOGETHER links are held at once."""
    a = b = np.zeros(0, np.int64)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["u", "v"])

    for batch in batches:
        for part in (batch.slice(i, TOGETHER) for i in range(0, len(batch), TOGETHER)):
            a, b = (np.concatenate([x, part.column(i).to_numpy()]) for i, x in enumerate((a, b)))
            if len(a) > TOGETHER:
                a, b = least_reached(a, b)
                a, b = a[a != b], b[a != b]
                if len(a) > TOGETHER // 2:
                    yield row()
                    a = b = np.zeros(0, np.int64)
    a, b = least_reached(a, b)
    a, b = a[a != b], b[a != b]
    yield row()


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links of one task."""
    links = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*((batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches), strict=True)] or [np.zeros(0, np.int64)] * 2
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reached(*links)], ["node", "component"])


def connected(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node that a link (a, b) with two ends names.

    Each task first replaces its links by as few as connect the same nodes. If TOGETHER or fewer are left,
    one task ends the work; such a graph isn't worth rounds, whose grouping and joins cost many tasks each.
    Others go through rounds of large-star and small-star steps: every node ties its larger neighbours to its least
    neighbour, then its smaller ones and itself, until stars are left. A round keeps the number of
    links and needs no node's neighbours in one task: the steps are a grouped minimum and a join.
    """
    edges = cut(links.filter("a <> b").select("a", "b").mapInArrow(_fewer, "u long, v long"))
    if edges.count() <= TOGETHER:
        parts = cut(edges.coalesce(1).mapInArrow(_together, "node long, component long"))
        drop(edges)
        return parts
    edges = cut(edges.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u <> v").distinct())
        # Stars: no node that has a smaller neighbour is a smaller neighbour itself, and each has one.
        if after.select("u").intersect(after.select("v")).isEmpty() and after.groupBy("u").count().filter("count > 1").isEmpty():
            break
        edges = after
    return cut(after.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
