"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import stored_with

#: Links that one task of a round gets, about: rounds over few links then have few tasks and
#: files, whatever the session's number of shuffle partitions.
LINKS = 100_000


def local_forest(links: DataFrame) -> DataFrame:
    """(u, v) -> (u, v) with v the smallest node that a task's own links join to
    u. Keeps the components and leaves at most one link for each node of a task."""
    def run(batches):
        for batch in batches:
            parent: dict[int, int] = {}

            def find(x: int) -> int:
                root = x
                while parent.setdefault(root, root) != root:
                    root = parent[root]
                while parent[x] != root:
                    parent[x], x = root, parent[x]
                return root

            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            rows = [(x, find(x)) for x in list(parent)]
            rows = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step, one exchange, read by at most so many ``tasks``: every node's
    neighbours arrive sorted, and are linked to the smallest of them. The large step looks
    at all neighbours and moves the larger ones; the small step at the smaller ones."""
    if large:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def run(batches):
        node, low = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([node is None or u[0] != node], u[1:] != u[:-1]))
            at = np.flatnonzero(new)
            lows = np.concatenate(([low], np.minimum(u[at], v[at])))  # of the node left open, then of each new one
            m = lows[np.cumsum(new)]
            node, low = u[-1], int(m[-1])
            move = (v > u) & (v != m) if large else v != m
            rows = np.stack([v[move], m[move]], axis=1)
            if not large:
                rows = np.concatenate((rows, np.stack([u[at], m[at]], axis=1)))
            rows = np.unique(rows, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["u", "v"])

    dealt = edges.repartition("u").coalesce(tasks)  # a node's rows stay in one task
    return local_forest(dealt.sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long"))


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (node, component): the smallest node reachable. Nodes
    without a link have no row. Each round is written to the shared folder, by as many
    tasks as its links need; the number of rounds grows with the logarithm of the longest chain."""
    seen = dict(n=F.count(F.lit(1)), links=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), most=F.max("u"))
    edges, state = stored_with(local_forest(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")), **seen)
    before = None
    while state != before and state["n"]:  # without links there is nothing to repeat
        before, tasks = state, -(-state["n"] // LINKS)
        edges, state = stored_with(star(star(edges, True, tasks), False, tasks), **seen)
    joined = edges.distinct().select(F.col("u").alias("node"), F.col("v").alias("component"))
    return joined.union(joined.select(F.col("component").alias("node"), "component").distinct())
