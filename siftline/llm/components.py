"""Connected components by alternating large-star and small-star steps, each contracted by its tasks.

Each step is an aggregation of minima (combined before the shuffle) and one equi-join, so a
hub with many neighbours is never gathered in one task. Edges and labels stay in tables. What a
task has of the edges it unites itself, some hundred thousand at a time, and passes on one edge
for each node to the smallest it reached: few tasks' edges are settled without a step, so a
small graph costs no plans, and a large one fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, thrifty

#: Edges that a task unites at once, and nodes whose minima are broadcast at most (some MB).
AT_ONCE, FEW = 1 << 19, 100_000


def forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the pairs in ``parent``, where every entry points at its set's smallest index.

    Returns the places of the pairs that joined two sets: of several that join the same set to
    another in one step, the first.
    """
    used, at = [], np.arange(len(a))
    while len(at):
        ra, rb = parent[a[at]], parent[b[at]]
        open_ = ra != rb
        if not open_.any():
            break
        at, ra, rb = at[open_], ra[open_], rb[open_]
        high, first = np.unique(np.maximum(ra, rb), return_index=True)
        parent[high] = np.minimum(ra, rb)[first]
        used.append(at[first])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    return np.concatenate(used) if used else np.zeros(0, np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) for each node u that edges held at once link to a smaller one, v the smallest."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = np.concatenate([x.column(c).to_numpy() for c in (0, 1) for x in held])
        names, at = np.unique(ends, return_inverse=True)
        parent = np.arange(len(names))
        forest(parent, *np.split(at, 2))
        below = np.flatnonzero(parent != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[below]), pa.array(names[parent[below]])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= AT_ONCE:
            yield star(held)
            held, rows = [], 0
    if rows:
        yield star(held)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, of the same components: united where they are, then where u's meet."""
    near = edges.select("u", "v").mapInArrow(thrifty(_stars), "u long, v long")
    return near.repartition("u").mapInArrow(thrifty(_stars), "u long, v long")


def _large_star(edges: DataFrame, nodes: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a hub's edges stay where they are while the minima, one for each of ``nodes``, can be sent to them
    return both.join(F.broadcast(least) if nodes <= FEW else least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v")


def _unsettled(edges: DataFrame) -> tuple[int, int]:
    """(nodes, how many of them have neither one edge to a root nor only edges from nodes below)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return tuple(each.agg(F.count("*"), F.count_if(F.expr("up > 1 OR up = 1 AND n > 1"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component the smallest node reachable.

    Nodes are whole numbers. Self-loops, repeated edges, either direction and null ends are allowed
    (null ends are dropped); no edges give an empty table. Raises if ``most_rounds`` do not settle it.
    """
    pair = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u != v")
    now = materialise(_contracted(pair), "edges")
    for _ in range(most_rounds):
        nodes, loose = _unsettled(now)
        if not loose:
            break
        new = materialise(_contracted(_small_star(_large_star(now, nodes))), "edges")
        release(now)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("u"), F.col("v").alias("v")).distinct()
    return now.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
