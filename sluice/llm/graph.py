"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

#: Nodes that a task joins at once.
NODES = 1_000_000


def forest(edges: DataFrame) -> DataFrame:
    """u, v: for each node of a task's edges the smallest node that these connect it to; a node with many edges has one a task."""

    def task(batches):
        above: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := above.get(top, top)) != top:
                top = up
            while (up := above.get(x, x)) != top:
                above[x], x = top, up
            return top

        def found():
            pairs = [(x, r) for x in above if (r := root(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs, strict=True) if pairs else ((), ()))], names=["u", "v"])
            above.clear()

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, q = root(x), root(y)
                if p != q:
                    above[max(p, q)] = min(p, q)
            if len(above) > NODES:
                yield from found()
        yield from found()

    return edges.mapInArrow(task, "u long, v long")


def least_neighbours(edges: DataFrame) -> DataFrame:
    """u, v, up: each u once with its smallest v (up), and its other v with that one (not up). u has at most one row a task."""

    def several(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        first = np.ones(len(u), dtype=bool)
        first[1:] = u[1:] != u[:-1]
        least = v[np.flatnonzero(first)][np.cumsum(first) - 1] if len(u) else v
        keep = first | (v != least)
        return pa.RecordBatch.from_arrays([pa.array(np.where(first, u, v)[keep]), pa.array(least[keep]), pa.array(first[keep])], names=["u", "v", "up"])

    def task(batches):
        """Rows come sorted by u and v."""
        held = None
        for b in batches:
            new = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            done = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if done:
                yield several(*(x[:done] for x in held))
                held = [x[done:] for x in held]
        if held is not None:
            yield several(*held)

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "u").sortWithinPartitions("u", "v").mapInArrow(task, "u long, v long, up boolean")


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """node, component (its smallest node) of each node of the edges (a, b).

    A round joins what each task's edges connect, gives each node its smallest neighbour and connects the other neighbours to
    that, then lets each node's neighbour be its neighbour's. Node with many edges have one a task after the first step, and the
    last one is a join, whose hot keys adaptive execution splits. Each round is written to the shared folder; it ends when every
    node's neighbour has none itself.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    last = None
    while True:
        stars = shelf.keep(least_neighbours(forest(now)))
        up, rest = stars.filter("up").select("u", "v"), stars.filter("not up").select("u", "v", F.lit(True).alias("moved"))
        over = up.select(F.col("u").alias("v"), F.col("v").alias("w"))
        jumped = up.join(over, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved"))
        after = shelf.keep(jumped.unionByName(rest))
        shelf.drop(stars, *([last] if last is not None else []))
        now = last = after
        if not after.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
