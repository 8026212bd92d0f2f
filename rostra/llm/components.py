"""Connected components of an edge table: tasks contract the edges that they hold, and alternating large-star and
small-star steps, all in joins, link what lies in several tasks.

A contraction needs no shuffle and links every node of a task's edges with the smallest that they connect it to, so a
table that fits one task is done after it, and others need fewer of the steps, of which each costs the driver half a
dozen exchanges.  Neither lets a node's smallest neighbour grow; where a round leaves all of these as they are, the next
one gives stars, and stars are what ends the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostra.llm.common import forget, stored, trim_driver, trimmed

#: Edges that a task takes up before it contracts them, and nodes that it keeps for the next ones (16 bytes each).
HELD = 1 << 18


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges: the nodes that aren't the smallest of their component, in order, and the smallest of each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs that connect the same nodes: u with the smallest that its task's edges connect it to."""
    held_most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return contracted(*(np.concatenate([x, *(f[k] for f in fresh)]) for k, x in enumerate((u, v))))

        for batch in batches:
            fresh.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(f[0]) for f in fresh) >= held_most:
                (u, v), fresh = merged(), []
                if len(u) >= held_most:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u, v = u[:0], v[:0]
        u, v = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select("u", "v").mapInArrow(lambda batches: trimmed(run(batches)), "u long, v long")


def _smallest(both: DataFrame) -> DataFrame:
    """u and the smallest of it and its neighbours; partial sums keep a node with many edges from being one task's."""
    return both.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("__m")).select("__u", F.least("__u", "__m").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, which is no u itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.where("up > 1 or up > 0 and down > 0").take(1)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (u, v); loops are ignored."""
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = stored(_contracted(ordered.distinct()), "edges")
    for _ in range(rounds):
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: each node's larger neighbours move to the smallest it knows
        large = both.where("v > u").join(_smallest(both), F.col("u") == F.col("__u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: each node and its smaller neighbours move to the smallest of them
        least = large.groupBy(F.col("u").alias("__u")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("__u"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("__u").alias("u"), F.col("m").alias("v")))
        after = stored(_contracted(small.where("u <> v").distinct()), "edges")
        forget(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    trim_driver(edges.sparkSession)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
