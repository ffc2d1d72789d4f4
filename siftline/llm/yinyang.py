"""Centroid clustering in integers: Lloyd's rounds that skip distances by Yinyang bounds.

The centroids are clustered into groups once, before the first round. From then on a vector
carries its cluster, an upper bound of the distance to its own centroid and, for each group, one
lower bound of the distance to the group's other centroids. When centroids move, the bounds move
with them: the upper one by the drift of the own centroid, a lower one by the group's largest
drift. A vector whose least lower bound is over its upper bound keeps its cluster (global
filter); else its own distance is measured and it is asked again; then only groups whose bound
isn't over the distance are scanned (group filter), with exact integer distances. A bound skips
only what is strictly farther, so ties are always measured, and rounding is on the safe side.

The vectors with their bounds are a table in the shared folder, written once a round; a lost
executor costs the tasks it ran. The driver holds the centroids and their sums (k times the
dimensions), whatever the number of vectors is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

#: Largest absolute component after quantising; squared distances of 64 such components still are longs.
LARGEST = 1 << 27
#: What bounds give for rounding, relative to them (square roots and sums of a few of them).
SLACK = 1e-12
#: Vectors that are worked on at once in a task.
AT_ONCE = 8192


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, q): vectors of exactly ``dim`` components, none null or non-finite, as floor(scale * x)."""
    v = F.col("v")
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    within = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST))
    chosen = chosen.where((F.size(v) == dim) & within)
    return chosen.select("id", F.transform(v, lambda x: F.floor(x * scale).cast("int")).alias("q"))


def grouped(centroids: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centroid: a few rounds of Lloyd on the centroids themselves."""
    k = len(centroids)
    groups = max(1, min(groups, k))
    at = centroids.astype(np.float64)
    middle = at[np.linspace(0, k - 1, groups).astype(int)]
    for _ in range(5):
        of = ((at[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        middle = np.array([at[of == g].mean(axis=0) if (of == g).any() else middle[g] for g in range(groups)])
    return of


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    largest = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    # doubles hold integers below 2**53, and their products of matrices are faster
    kind = np.float64 if 4 * q.shape[1] * largest * largest < 1 << 53 else np.int64
    a, b = q.astype(kind), centroids.astype(kind)
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return out.astype(np.int64)


def first_assigned(q: np.ndarray, centroids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, upper, lower): every distance measured."""
    d = distances(q, centroids)
    rows = np.arange(len(q))
    cluster = d.argmin(axis=1)
    upper = np.sqrt(d[rows, cluster].astype(np.float64)) * (1 + SLACK)
    others = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
    others[rows, cluster] = np.inf
    lower = np.stack([others[:, of == g].min(axis=1, initial=np.inf) for g in range(of.max() + 1)], axis=1)
    return cluster, upper, lower


def reassigned(
    q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, of: np.ndarray, drift: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, upper, lower, distances measured) once the centroids have moved by ``drift``."""
    n_groups = lower.shape[1]
    most = np.array([drift[of == g].max(initial=0.0) for g in range(n_groups)])
    cluster, upper = cluster.copy(), (upper + drift[cluster]) * (1 + SLACK)
    lower = np.maximum(0.0, (lower - most) * (1 - SLACK))
    rows = np.flatnonzero(lower.min(axis=1) <= upper)  # global filter
    own = ((q[rows].astype(np.int64) - centroids[cluster[rows]]) ** 2).sum(axis=1)
    measured = len(rows)
    upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
    left = lower[rows].min(axis=1) <= upper[rows]
    rows, own = rows[left], own[left]
    best, best_d = cluster[rows].copy(), own.copy()
    found = []
    for g in range(n_groups):
        members = np.flatnonzero(of == g)
        at = np.flatnonzero(lower[rows, g] <= np.sqrt(best_d.astype(np.float64)) * (1 + SLACK))  # group filter
        if not len(at):
            continue
        d = distances(q[rows[at]], centroids[members])
        measured += d.size
        near = d.argmin(axis=1)
        least = d[np.arange(len(at)), near]
        better = (least < best_d[at]) | ((least == best_d[at]) & (members[near] < best[at]))
        best[at[better]], best_d[at[better]] = members[near[better]], least[better]
        found.append((g, members, at, d))
    old = cluster[rows]
    moved = np.flatnonzero(best != old)  # the centroid they leave is another one of its group now
    left_at = rows[moved], of[old[moved]]
    lower[left_at] = np.minimum(lower[left_at], np.sqrt(own[moved].astype(np.float64)) * (1 - SLACK))
    for g, members, at, d in found:
        others = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
        others[best[at][:, None] == members[None, :]] = np.inf
        lower[rows[at], g] = others.min(axis=1)
    cluster[rows], upper[rows] = best, np.sqrt(best_d.astype(np.float64)) * (1 + SLACK)
    return cluster, upper, lower, measured


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


_STATE = "id long, q array<int>, cluster int, upper double, lower array<double>"


def _assign(centroids: np.ndarray, of: np.ndarray, drift: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), AT_ONCE):
                batch = whole.slice(low, AT_ONCE)
                q = _rows(batch.column(1), centroids.shape[1])
                if drift is None:
                    cluster, upper, lower = first_assigned(q, centroids, of)
                else:
                    cluster, upper = (batch.column(c).to_numpy() for c in (2, 3))
                    cluster, upper, lower, _ = reassigned(q, cluster, upper, _rows(batch.column(4), of.max() + 1), centroids, of, drift)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), _lists(lower)], ["id", "q", "cluster", "upper", "lower"]
                )

    return run


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task's vectors by cluster and component; place ``dim`` is their number."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cluster, q = batch.column(0).to_numpy(), _rows(batch.column(1), dim)
            for c in np.unique(cluster).tolist():
                mine = q[cluster == c]
                total[c] = total.get(c, 0) + np.append(mine.sum(axis=0, dtype=np.int64), len(mine))
        for c, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, c, np.int32)), pa.array(np.arange(dim + 1)), pa.array(sums)], ["cluster", "place", "total"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of the mean of each cluster's vectors; centroids without vectors stay."""
    dim = centroids.shape[1]
    parts = state.select("cluster", "q").mapInArrow(_sums(dim), "cluster int, place long, total long")
    parts = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    total = {(r.cluster, r.place): int(r.total) for r in parts.collect()}  # k times the dimensions
    out = centroids.copy()
    for c in range(len(centroids)):
        if n := total.get((c, dim)):
            out[c] = [total[c, j] // n for j in range(dim)]
    return out


def _measured(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column(2).to_numpy()
            d = ((_rows(batch.column(1), centroids.shape[1]).astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(d)], ["id", "cluster", "distance"])

    return run


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 64, k: int = 16,
    rounds: int = 3, groups: int = 4, salt: str = "1:",
) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid), one row per kept vector.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; a component x
    becomes floor(scale * x). The first centroids are the ``k`` vectors with the smallest
    SHA-256 of ``salt`` and their id, in that order (null ids come last, equal ids in the order
    of their vectors); fewer vectors make fewer centroids. Each of ``rounds`` rounds assigns every vector to
    the nearest centroid (ties: the smaller number) and moves each centroid that has vectors to
    the floor of their mean; then vectors are assigned once more. Distances are squared; the
    sums are over a vector's cluster and over all.

    Vectors with a component of 2**27 or more after scaling are left out like non-finite ones,
    as their distances are no longs. An inertia beyond a long is null. Repeated rows are
    vectors of their own. Other columns are ignored. No vectors give an empty table.
    """
    points = materialise(quantised(vectors, id_col, vector_col, dim, scale), "vectors")
    spark = points.sparkSession
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    starts = points.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()
    if not starts:
        kinds = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
        return spark.createDataFrame([], kinds)
    centroids = np.array([r.q for r in starts], np.int64)
    of = grouped(centroids, groups)
    state = materialise(points.mapInArrow(_assign(centroids, of, None), _STATE), "state")
    release(points)
    for _ in range(rounds):
        new = moved(state, centroids)
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        after = materialise(state.mapInArrow(_assign(new, of, drift), _STATE), "state")
        release(state)
        state, centroids = after, new
    found = materialise(state.mapInArrow(_measured(centroids), "id long, cluster int, distance long"), "clusters")
    release(state)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    names = [
        (c, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), centroids[c].tolist())
        for c, s in sums.items()
    ]
    kinds = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    told = F.broadcast(spark.createDataFrame(names, kinds))  # a row per centroid
    return found.join(told, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
