"""Connected components of an edge table by alternating large-star and small-star steps, in DataFrame operations.

Tasks join what lies in the same PART edges before those are shuffled, which spares steps; edges that are no more than PART in
all are done then.  Each step's edges are written to the shared folder, so lineage stays short and a lost executor costs one
step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import remove, stored

#: Edges that a task joins at once, whatever the table's size: 2 MB of numbers.
PART = 1 << 17


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes that aren't the smallest of their component, the smallest one) for the edges (u, v)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    f = np.arange(len(nodes))
    while True:
        up, new = f[f], f[f]
        for x, y in ((f[a], b), (f[b], a), (a, b), (b, a)):
            np.minimum.at(new, x, up[y])
        if (new == f).all():
            break
        f = new
    out = f < np.arange(len(nodes))
    return nodes[out], nodes[f[out]]


def _parts_joined(e: DataFrame) -> DataFrame:
    """Edges (u, v) from each node to the smallest one that PART edges of its partition reach; no more edges than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def joined() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in least_reached(u, v)], names=["u", "v"])

        for b in batches:
            if held and n + b.num_rows > PART:
                yield joined()
                held, n = [], 0
            held.append(b)
            n += b.num_rows
        if n:
            yield joined()

    return e.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long) that isn't the smallest of its component."""
    now = stored(_parts_joined(edges.where("u != v")), "components")
    mark = None
    while True:
        one = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if one["n"] == 0 or (one["n"], one["h"]) == mark:
            break
        mark = (one["n"], one["h"])
        last = one["n"] <= PART
        after = stored(_parts_joined(now.coalesce(1) if last else _small_star(_large_star(now))), "components")
        remove(now)
        now = after
        if last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
