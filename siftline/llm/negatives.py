"""Hard negatives by an orthogonal PCA rotation with partial inner products.

Vectors are integers, and so are scores. One rotation (eigenvectors of the second moments of all
vectors, largest first) leaves inner products as they are and moves most of a vector's length to
its leading components. A pair's product is accumulated over the leading components stage by
stage; what the remaining ones can add or take away is at most the product of both residual
norms, plus a slack for rounding. A pair that can reach no threshold is discarded early, the
survivors of the last stage are scored with exact integer products. Thresholds are the scores
an anchor has found so far in the block.

Anchors meet rows in blocks: rows and anchors are dealt to blocks by a hash of their ids, so
whatever one label holds, a task has one block of each. Positives only meet within their label;
negatives meet all blocks of their length. A block returns at most the rows that are asked for
an anchor (or an anchor's positive), and a rank over those settles the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

#: Squared norms stay below this, so that a hundred times any product is a long.
LARGEST = 1 << 56
#: Numbers in a block of rows, anchors in a block, and row blocks of a length at least.
NUMBERS, ANCHORS, SHARES = 1 << 20, 1024, 16
#: Numbers in the matrices of all rotations together; rarer lengths keep their axes.
ROTATED = 4 << 20
#: Rows that a block's anchors meet at once, and the share of pairs from which they are taken one by one.
AT_ONCE, FEW = 1024, 0.1
#: Shares of the components after which a pair may be discarded.
STAGES = (0.25, 0.5, 0.75, 1.0)


def _rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def points_of(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, dim, q): rows that take part, one for each id, with components floor(scale * x)."""
    v = F.col("v")
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < 1 << 28))
    chosen = chosen.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & whole)
    chosen = chosen.select("id", "label", F.transform(v, lambda x: F.floor(x * scale)).alias("q"))
    chosen = chosen.where(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < float(LARGEST))
    one = chosen.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("id", "r.label", F.size("r.q").alias("dim"), "r.q")


def _moments(dims: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: np.zeros((dim, dim)) for dim in dims}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for dim in total:
                at = np.flatnonzero(sizes == dim)
                x = _rows(batch.column(1).take(pa.array(at)), dim).astype(np.float64)
                total[dim] += x.T @ x
        for dim, sums in total.items():
            if sums.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sums.size, dim, np.int32)), pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["dim", "cell", "total"])

    return run


def rotations(points: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes of the vectors of each length, largest first; the commonest lengths up to ROTATED numbers.

    Without an entry a length keeps its own axes, which are orthogonal too: only speed differs.
    """
    dims, room = [], ROTATED
    for r in points.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(64).collect():
        if 0 < r.dim * r.dim <= room:
            dims.append(r.dim)
            room -= r.dim * r.dim
    cells = points.select("dim", "q").mapInArrow(_moments(dims), "dim int, cell long, total double").groupBy("dim", "cell").agg(F.sum("total").alias("total"))
    sums = {dim: np.zeros(dim * dim) for dim in dims}
    for r in cells.toLocalIterator():
        sums[r.dim][r.cell] = r.total
    out = {}
    for dim, cell in sums.items():
        square = cell.reshape(dim, dim)
        out[dim] = np.linalg.eigh((square + square.T) / max(1.0, np.abs(square).max()))[1][:, ::-1]
    return out


class Rotated:
    """Integer vectors with their rotated components and the norms of what is left after each stage."""

    def __init__(self, q: np.ndarray, axes: np.ndarray | None):
        self.q, dim = q, q.shape[1]
        x = q.astype(np.float64)
        self.x = x if axes is None else x @ axes
        self.cuts = sorted({max(1, round(dim * s)) for s in STAGES} if dim else {0})
        self.left = np.stack([np.sqrt((self.x[:, c:] ** 2).sum(axis=1)) for c in self.cuts], axis=1) if len(q) else np.zeros((0, len(self.cuts)))
        # sums of dim products and a rotation that is orthogonal but for rounding
        self.slack = np.sqrt((x**2).sum(axis=1)) * np.sqrt(16.0 * (dim + 4) * np.finfo(float).eps * (dim + 4))


def survivors(a: Rotated, b: Rotated, rows: slice, pairs: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact product) of the ``pairs`` whose products may lie within [low, high] of their anchor."""
    room = a.slack[:, None] * b.slack[rows][None, :]
    so_far, at, done = np.zeros(pairs.shape), pairs, 0
    i = j = None
    for stage, cut in enumerate(a.cuts):
        if i is None:
            so_far += a.x[:, done:cut] @ b.x[rows, done:cut].T
            rest = a.left[:, stage][:, None] * b.left[rows, stage][None, :] + room
            at = at & (so_far + rest >= low[:, None]) & (so_far - rest <= high[:, None])
            if np.count_nonzero(at) <= FEW * at.size or stage == len(a.cuts) - 1:
                i, j = np.nonzero(at)
                so_far = so_far[i, j]
        else:
            so_far = so_far + np.einsum("ij,ij->i", a.x[i, done:cut], b.x[rows.start + j, done:cut])
            rest = a.left[i, stage] * b.left[rows.start + j, stage] + room[i, j]
            good = (so_far + rest >= low[i]) & (so_far - rest <= high[i])
            i, j, so_far = i[good], j[good], so_far[good]
        done = cut
    return i, rows.start + j, np.einsum("ij,ij->i", a.q[i], b.q[rows.start + j])


def best(key: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each key, by falling score and then by id."""
    order = np.lexsort((ids, -score, key))
    key = key[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
    return order[rank < most]


def _floors(key: np.ndarray, score: np.ndarray, most: int, floors: np.ndarray) -> np.ndarray:
    """``floors``, raised to the last score of each key that has its ``most`` rows."""
    out = floors.copy()
    full = np.bincount(key, minlength=len(out))[: len(out)] >= most
    least = np.full(len(out), np.iinfo(np.int64).max)
    np.minimum.at(least, key, score)
    out[full] = np.maximum(out[full], least[full])
    return out


def _split(table: pa.Table, axes: dict[int, np.ndarray]) -> tuple[pa.Table, pa.Table, Rotated, Rotated]:
    anchor = table.column("anchor").to_numpy()
    dim = table.column("dim")[0].as_py()
    halves = [table.take(pa.array(np.flatnonzero(anchor == k))) for k in (True, False)]
    return *halves, *(Rotated(_rows(h.column("q"), dim), axes.get(dim)) for h in halves)


def _positives(axes: dict[int, np.ndarray], most: int):
    def run(table: pa.Table) -> pa.Table:
        """The first rows of a block for each anchor, the anchor itself left out."""
        anchors, others, a, b = _split(table, axes)
        aid, bid = anchors.column("id").to_numpy(), others.column("id").to_numpy()
        i, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = np.full(len(aid), -np.inf), np.full(len(aid), np.inf)
        floors = np.full(len(aid), np.iinfo(np.int64).min)
        for start in range(0, len(bid), AT_ONCE):
            rows = slice(start, min(start + AT_ONCE, len(bid)))
            found = survivors(a, b, rows, aid[:, None] != bid[rows][None, :], low, high)
            i, j, s = (np.concatenate(pair) for pair in zip((i, j, s), found))
            kept = best(i, bid[j], s, most)
            i, j, s = i[kept], j[kept], s[kept]
            floors = _floors(i, s, most, floors)
            low = np.where(floors > np.iinfo(np.int64).min, floors.astype(np.float64), -np.inf)
        return pa.table({"anchor_id": aid[i], "positive_id": bid[j], "positive_score": s})

    return run


def _negatives(axes: dict[int, np.ndarray], most: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """The first rows of a block for each positive of an anchor, with another label and a score in the positive's range."""
        anchors, others, a, b = _split(table, axes)
        aid, bid = anchors.column("id").to_numpy(), others.column("id").to_numpy()
        la, lb = anchors.column("label").to_numpy(), others.column("label").to_numpy()
        goals = anchors.column("goals").combine_chunks()
        n = np.diff(goals.offsets.to_numpy())
        owner, first = np.repeat(np.arange(len(aid)), n), np.cumsum(n) - n
        goal = goals.flatten()
        pid, ps = goal.field("positive_id").to_numpy(), goal.field("positive_score").to_numpy()
        floors = -((-percent * ps) // 100)  # the least score of a positive's negatives
        high = np.maximum.reduceat(ps, first).astype(np.float64) if len(ps) else np.zeros(0)
        p, j, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for start in range(0, len(bid), AT_ONCE):
            rows = slice(start, min(start + AT_ONCE, len(bid)))
            low = np.minimum.reduceat(floors, first).astype(np.float64) if len(ps) else np.zeros(0)
            i, at, score = survivors(a, b, rows, la[:, None] != lb[rows][None, :], low, high)
            again = np.repeat(np.arange(len(i)), n[i])
            mine = first[i][again] + np.arange(len(again)) - np.repeat(np.cumsum(n[i]) - n[i], n[i])
            fits = (percent * ps[mine] <= 100 * score[again]) & (score[again] <= ps[mine])
            found = mine[fits], at[again[fits]], score[again[fits]]
            p, j, s = (np.concatenate(pair) for pair in zip((p, j, s), found))
            kept = best(p, bid[j], s, most)
            p, j, s = p[kept], j[kept], s[kept]
            floors = _floors(p, s, most, floors)
        return pa.table({"anchor_id": aid[owner[p]], "positive_id": pid[p], "negative_id": bid[j], "positive_score": ps[p], "negative_score": s})

    return run


def _first(found: DataFrame, keys: list[str], other: str, score: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key; Spark cuts each task's rows before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _dealt(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and anchors of equal ``keys``, copied to the blocks in which they meet.

    A block has few rows however many a key has; keys without anchors or without rows have none.
    """
    per_block = F.greatest(F.lit(256), F.floor(F.lit(NUMBERS) / F.greatest(F.lit(1), F.col("dim"))))
    nr = rows.groupBy(*keys).agg(F.greatest(F.lit(SHARES if keys == ["dim"] else 1), F.ceil(F.count("*") / F.any_value(per_block))).cast("int").alias("nr"))
    na = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("na"))
    sizes = nr.join(na, keys)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tail = ["id", "label", "dim", "q", "goals"]
    left = rows.join(sizes, keys).withColumns({"rb": mine("nr"), "ab": all_of("na"), "anchor": F.lit(False)})
    right = anchors.join(sizes, keys).withColumns({"ab": mine("na"), "rb": all_of("nr"), "anchor": F.lit(True)})
    return left.select("ab", "rb", "anchor", *tail).union(right.select("ab", "rb", "anchor", *tail))


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, is_anchor: Column | None = None,
    scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label``: a column of ``vectors`` (default ``label``), an integer; ``is_anchor``: a
    predicate on the column ``id`` (default: divisible by 100). Components become
    floor(scale * x), scores are integer inner products, higher ones come first, ties by the
    smaller id. An anchor's positives are its first ``positives`` other rows of its label; for
    each, the first ``negatives`` rows of other labels with percent * positive_score <=
    100 * negative_score <= 100 * positive_score are returned, ranked from 1. So a positive with
    a negative score has none, one with score 0 those with score 0.

    Rows with a null id or label, a null vector, or any null or non-finite component take no
    part, nor do those with a squared norm of 2**56 or more after scaling, whose scores are no
    longs. Vectors of different lengths have no inner product and do not meet; empty ones meet
    with score 0. Of rows that repeat an id, the one with the smallest label and vector stands for
    all. Other columns are ignored. No anchors or no rows give an empty table.
    """
    table = materialise(points_of(vectors, id_col, vector_col, F.col("label") if label is None else label, scale), "points")
    points = table.withColumn("goals", F.lit(None).cast("array<struct<positive_id:bigint,positive_score:bigint>>"))
    axes = rotations(points)
    anchors = points.where(F.col("id") % 100 == 0 if is_anchor is None else is_anchor)
    block = ["label", "dim", "ab", "rb"]
    near = _dealt(points, anchors, ["label", "dim"]).groupBy(*block).applyInArrow(_positives(axes, positives), "anchor_id long, positive_id long, positive_score long")
    near = materialise(_first(near, ["anchor_id"], "positive_id", "positive_score", positives).drop("rank"), "positives")
    # at most ``positives`` of an anchor; a positive below zero has no range
    goals = near.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("positive_id", "positive_score"))).alias("goals"))
    anchors = materialise(anchors.drop("goals").join(goals, "id").select("id", "label", "dim", "q", "goals"), "anchors")
    kinds = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    hard = _dealt(points, anchors, ["dim"]).groupBy("dim", "ab", "rb").applyInArrow(_negatives(axes, negatives, percent), kinds)
    hard = materialise(_first(hard, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives), "negatives")
    for read in (table, near, anchors):
        release(read)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
