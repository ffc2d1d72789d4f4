"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. After one fixed random
rotation a vector is cut into blocks of about BLOCK dimensions; each block gets its share of
that budget in proportion to its dimensions, and a pair within the whole budget is within the
share of at least one block. So each block is range-joined: its space is split by a k-d tree, whose
cells a vector visits if its ball overlaps them, and within a cell by a window of one
dimension and the block's distance. Trees are built from a bounded sample, and their depth follows the
number of vectors of a label, so a cell's vectors stay about as many while labels grow. Pairs left are
verified with the cosine in double precision.

A pair is counted at the first block whose share it keeps, in the cell its partner lives in:
so links are counted without listing or joining pairs. A task returns a row for each vector
with links, with their number and one member of its group. Cells with many rows are dealt out
in blocks of homes against blocks of visitors. Equal vectors are one node with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components
from .simhash import forest

BLOCK = 8
#: Vectors in a cell aimed at; homes and visitors that one task compares; rows compared at once.
LEAF, HOMES, VISITORS, AT_ONCE = 1_024, 4_000, 16_000, 256
#: Vectors that trees are built from, numbers in them, and lengths of vectors that get trees, at most;
#: sampled vectors in a leaf at least. Beyond that depth (LEAF * SAMPLE / FEWEST vectors of a label) cells grow.
SAMPLE, NUMBERS, LENGTHS, FEWEST = 1 << 16, 1 << 22, 8, 4
#: Room for rounding in what selects candidates (squared distances of unit vectors).
SLACK = 1e-7


@lru_cache(maxsize=4)
def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def cuts_of(dim: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, max(1, round(dim / BLOCK)) + 1).round().astype(int))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _rotated(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ _rotation(x.shape[1])


def build_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, cut) of the nodes of ``depth`` levels, in heap order: the median along the axis of the largest spread."""
    axis, cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    members = {0: np.arange(len(x))}
    for k in range(len(axis)):
        own = x[members[k]]
        axis[k] = int(own.var(axis=0).argmax()) if len(own) else 0
        cut[k] = float(np.median(own[:, axis[k]])) if len(own) else 0.0
        left = own[:, axis[k]] <= cut[k]
        members[2 * k + 1], members[2 * k + 2] = members[k][left], members[k][~left]
        del members[k]
    return axis, cut


def trees_of(nodes: DataFrame, sizes: DataFrame, leaf: int, sample: int = SAMPLE) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """The trees of the blocks of each of the commonest lengths, as deep as labels and the sample ask for."""
    out, grain = {}, 1 << 24
    for r in sizes.groupBy("dim").agg(F.sum("n").alias("n"), F.max("n").alias("most")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        wanted = max(1, min(sample, NUMBERS // r.dim))
        share = min(grain, math.ceil(grain * wanted / r.n))
        taken = nodes.where((F.col("dim") == r.dim) & (F.pmod(F.xxhash64("k1", F.lit(3)), F.lit(grain)) < share)).limit(2 * wanted).select("vec").toArrow()
        u = _rotated(_matrix(taken.column("vec").combine_chunks(), r.dim)) if taken.num_rows else np.zeros((0, r.dim))
        depth = max(0, min(math.ceil(math.log2(max(1, r.most / leaf))), int(math.log2(max(1, len(u) / FEWEST)))))
        cuts = cuts_of(r.dim)
        out[r.dim] = [build_tree(u[:, a:b], depth) for a, b in zip(cuts, cuts[1:])]
    return out


def route(u: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): each row's own cell, ``depth`` levels down, and the others that its ball overlaps."""
    axis, cut = tree
    row, node, home, done = np.arange(len(u)), np.zeros(len(u), np.int64), np.ones(len(u), bool), []
    for level in range(int(depth.max(initial=0)) + 1):
        stop = (depth[row] <= level) | (node >= len(axis))
        done.append((row[stop], node[stop], home[stop]))
        row, node, home = row[~stop], node[~stop], home[~stop]
        if not len(row):
            break
        x = u[row, axis[node]]
        left, right, lives_left = x - radius <= cut[node], x + radius > cut[node], x <= cut[node]
        row, node, home = (
            np.concatenate((row[left], row[right])),
            np.concatenate((2 * node[left] + 1, 2 * node[right] + 2)),
            np.concatenate((home[left] & lives_left[left], home[right] & ~lives_left[right])),
        )
    return tuple(np.concatenate(c) for c in zip(*done))


def _place(batches: Iterator[pa.RecordBatch], threshold: float, trees: dict) -> Iterator[pa.RecordBatch]:
    """For each block of each vector the cells (slab) it visits, with a mark on the one it lives in."""
    for whole in batches:
        for low in range(0, len(whole), 1024):
            batch = whole.slice(low, 1024)
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                u, depth = _rotated(_matrix(batch.column(2).take(pa.array(rows)), dim)), batch.column(3).to_numpy()[rows]
                cuts, budget = cuts_of(dim), 2 - 2 * threshold
                for b, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    radius = math.sqrt(budget * (z - a) / dim + SLACK)
                    tree = trees[dim][b] if dim in trees else (np.zeros(0, np.int64), np.zeros(0))
                    at, cell, home = route(u[:, a:z], tree, depth, radius)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[at])), pa.array(np.full(len(at), b)), pa.array(cell), pa.array(home)], ["nid", "block", "slab", "home"])


def _linked(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of the visitors with the homes of one part of a cell."""
        dim, b = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        nid, times = (table.column(c).to_numpy() for c in ("nid", "times"))
        role = table.column("role").to_numpy()
        x = _matrix(table.column("vec").combine_chunks(), dim)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        u, cuts = x @ _rotation(dim), cuts_of(dim)
        share = (2 - 2 * threshold) * np.diff(cuts) / dim
        own = slice(cuts[b], cuts[b + 1])
        second = u[:, cuts[b]]
        home, visit = (r[np.argsort(second[r], kind="stable")] for r in (np.flatnonzero(role != 0), np.flatnonzero(role != 1)))
        radius = math.sqrt(share[b] + SLACK)
        uh, size = u[home, own], (u[:, own] ** 2).sum(axis=1)
        names, node = np.unique(nid, return_inverse=True)
        links, parent = np.zeros(len(names), np.int64), np.arange(len(names))
        for at in range(0, len(visit), AT_ONCE):
            v = visit[at : at + AT_ONCE]
            lo = np.searchsorted(second[home], second[v[0]] - radius, "left")
            hi = np.searchsorted(second[home], second[v[-1]] + radius, "right")
            for low in range(lo, hi, 8192):
                h = home[low : min(hi, low + 8192)]
                gap = size[v][:, None] + size[h][None, :] - 2 * (u[v, own] @ uh[low : low + len(h)].T)
                i, j = np.nonzero(gap <= share[b] + SLACK)
                for part in range(0, len(i), 65_536):
                    p, q = v[i[part : part + 65_536]], h[j[part : part + 65_536]]
                    kept = nid[p] != nid[q]
                    p, q = p[kept], q[kept]
                    gaps = np.add.reduceat((u[p] - u[q]) ** 2, cuts[:-1], axis=1) if len(p) else np.zeros((0, len(share)))
                    # the sum of the gaps may pass the budget by rounding only
                    first = np.argmax(gaps <= share + SLACK / 2, axis=1)
                    good = (first == b) & (np.einsum("ij,ij->i", x[p], x[q]) >= threshold)
                    p, q = p[good], q[good]
                    np.add.at(links, node[p], times[q])
                    forest(parent, node[p], node[q])
        out = np.flatnonzero((links > 0) | (parent != np.arange(len(names))))
        return pa.table({"nid": names[out], "links": links[out], "mate": names[parent[out]]})

    return run


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row per input row.

    Vectors link if their labels are equal and not null, their lengths are equal, and their
    cosine in double precision is ``threshold`` or more. ``n_links``: other rows linked
    directly; ``component_id``: the smallest id that links reach, its own included; ``kept``:
    whether that is the row's own id. Null, empty and zero vectors and those that hold null or
    non-finite components link with nothing, a null id's neither: such a row has no links and
    its own id. Repeated rows link. Other columns are ignored. 0.5 <= threshold <= 1.
    """
    v = F.col("v")
    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    whole = F.coalesce(F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))), F.lit(False))
    fit = F.col("label").isNotNull() & F.col("id").isNotNull() & whole & F.exists(v, lambda c: F.coalesce(c != 0, F.lit(False)))
    chosen = chosen.withColumn("v", v.cast("array<double>"))
    # the cosine does not depend on lengths; squares of very large or small components would leave the range of doubles
    most = F.array_max(F.transform(v, F.abs))
    chosen = chosen.withColumn("v", F.when(most.between(1e-100, 1e100) | (most == 0) | ~(most < float("inf")), v).otherwise(F.transform(v, lambda c: c / most)))
    each = chosen.select("id", "label", "v", fit.alias("fit"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    keys = ["label", "k1", "k2"]
    nodes = materialise(
        each.where("fit").groupBy(*keys).agg(F.min("id").alias("nid"), F.count("*").alias("times"), F.any_value("v").alias("vec")).withColumn("dim", F.size("vec")),
        "nodes",
    )
    counts = materialise(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), "counts")
    trees = trees_of(nodes, counts, LEAF)
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF))).cast("int").alias("depth")
    plain = nodes.join(counts, ["label", "dim"]).select("nid", "dim", "vec", deep)
    placed = plain.mapInArrow(lambda batches: _place(batches, threshold, trees), "nid long, block long, slab long, home boolean")
    placed = placed.join(nodes.select("nid", "label", "dim"), "nid")
    where = ["label", "dim", "block", "slab"]
    sizes = placed.groupBy(*where).agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / HOMES)).cast("int").alias("nh"),
        F.ceil(F.count("*") / VISITORS).cast("int").alias("nv"),
    )
    mine = lambda n: F.pmod(F.xxhash64("nid"), F.col(n)).cast("int")
    role = lambda h, w, r: F.struct(h.cast("int").alias("h"), w.cast("int").alias("w"), F.lit(r).alias("role"))
    as_home = F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda w: role(mine("nh"), w, 1))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda h: role(h, mine("nv"), 0))
    one = (F.col("nh") == 1) & (F.col("nv") == 1)
    roles = (
        F.when(one & F.col("home"), F.array(role(F.lit(0), F.lit(0), 2)))
        .when(F.col("home"), F.concat(as_home, as_visitor))
        .otherwise(as_visitor)
    )
    dealt = placed.join(sizes, where).select("nid", *where, F.explode(roles).alias("r")).select("nid", *where, "r.*")
    dealt = dealt.join(nodes.select("nid", "times", "vec"), "nid")
    found = materialise(dealt.groupBy(*where, "h", "w").applyInArrow(_linked(threshold), "nid long, links long, mate long"), "links")

    groups = components(found, "nid", "mate")
    counted = found.groupBy("nid").agg(F.sum("links").alias("links"))
    named = (
        nodes.select(*keys, "nid", "times").join(counted, "nid", "left").join(groups, F.col("nid") == F.col("node"), "left")
        .select(*keys, (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "nid").alias("component_id"))
    )
    named = materialise(named, "named")
    good = each.where("fit").select("id", *keys).join(named, keys).select("id", "n_links", "component_id")
    rest = each.where("NOT fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
