"""SimHash near-duplicates: fingerprints, and vantage-point trees that find all close pairs.

The 64 bits are cut into ``max_bits`` + 2 blocks. Two fingerprints that differ in at most ``max_bits``
bits agree in full on two blocks at least, so there is a table for each pair of blocks, and a
fingerprint is in one part of each table, the one of its bits in those blocks: 15 copies for 4 bits,
whatever their number. A part that is larger than a shard is divided by a vantage-point tree over
the Hamming distance. A node has a vantage point v and a split s; a fingerprint lives left if
d(v) <= s, else right, and a search visits left if d(v) - max_bits <= s and right if d(v) + max_bits
> s: branches that the triangle inequality rules out are pruned, and shards whose boundary the ball
overlaps are visited. What no bound rules out is compared exactly over all 64 bits.

A node's vantage point is a hash of its place, so tasks know trees of any depth, and a part's depth
follows the number of its fingerprints. A shard that stays large is
dealt out in blocks of homes against blocks of visitors, so no task holds a whole shard. Each
task returns a spanning forest of its links and not all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mixed, small, thrifty
from .components import components, forest

SEED = 42
#: Homes and visitors that one block compares, and homes of a shard aimed at.
HOMES, VISITORS = 4_096, 65_536
#: Pairs compared at once within a task.
AT_ONCE = 1 << 19
#: Members of a part up to which parts are compared side by side, neighbours by neighbours.
FEW = 32


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text, as an unsigned 64-bit number.

    A-Z are lower-cased; words are runs without the space and 09-0D; a shingle is ``width``
    words joined by spaces, or the whole sequence if there are fewer. Repeats count. A bit is
    1 if set in over half the hashes. No words (null, empty, blank): 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())),
        np.uint64,
        len(words) - width + 1,
    )
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(ones.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): one row per input row, fp the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(thrifty(run), "id long, fp long")


def tables_of(max_bits: int) -> list[int]:
    """The masks of the tables: each pair of ``max_bits`` + 2 blocks of the 64 bits, on one of which close fingerprints agree in full."""
    cuts = [round(64 * k / (max_bits + 2)) for k in range(max_bits + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in itertools.combinations(blocks, 2)]


def route(fp: np.ndarray, part: np.ndarray, depth: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home): the shard of its part's tree that each row lives in, and the others that its ball overlaps.

    ``part``: a number for each row's part, which makes its vantage points. A part's bits are equal, so
    distances are those of the others: about half of 64 less the part's bits.
    """
    row, node, home, done = np.arange(len(fp)), np.zeros(len(fp), np.int64), np.ones(len(fp), bool), []
    for level in range(int(depth.max(initial=0)) + 1):
        stop = depth[row] <= level
        done.append((row[stop], node[stop], home[stop]))
        row, node, home = row[~stop], node[~stop], home[~stop]
        if not len(row):
            break
        point = mixed(part[row] + mixed(node.astype(np.uint64) + np.uint64(1)))
        far = np.bitwise_count(fp[row] ^ point).astype(np.int64)
        left, right, lives_left = far - radius <= 31, far + radius > 31, far <= 31
        row, node, home = (
            np.concatenate((row[left], row[right])),
            np.concatenate((2 * node[left] + 1, 2 * node[right] + 2)),
            np.concatenate((home[left] & lives_left[left], home[right] & ~lives_left[right])),
        )
    return tuple(np.concatenate(c) for c in zip(*done))


def close_pairs(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (visitor, home) within ``max_bits``, where the visitor's number is smaller."""
    step = max(1, AT_ONCE // max(1, len(homes)))
    for at in range(0, len(visitors), step):
        part = visitors[at : at + step, None]
        far = np.bitwise_count(part ^ homes[None, :])
        v, h = np.nonzero((far <= max_bits) & (part < homes[None, :]))
        if len(v):
            near_first = np.argsort(far[v, h], kind="stable")
            yield v[near_first] + at, h[near_first]


_PART = ["part", "key", "shard", "hb", "vb"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of a task in tables that cut no group of equal _PART, each of some thousands of rows or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        columns = [batch.column(c).to_numpy() for c in _PART]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1
        last = int(new[-1]) if len(new) else 0
        first = [held[-1].column(c)[-1].as_py() for c in _PART] if held else None
        if held and first != [x[0] for x in columns] and not last:
            yield pa.Table.from_batches(held)
            held = [batch]
        elif last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _linked(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            fp, rep, role = (table.column(c).to_numpy() for c in ("fp", "rep", "role"))
            fp = fp.view(np.uint64)
            keys = [table.column(c).to_numpy() for c in _PART]
            starts = np.concatenate(([0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1, [len(fp)]))
            sizes = np.diff(starts)
            names, first, at = np.unique(fp, return_index=True, return_inverse=True)
            parent, name = np.arange(len(names)), rep[first]
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def joined(a: np.ndarray, b: np.ndarray) -> None:
                used = forest(parent, a, b)
                u.append(a[used]), v.append(b[used])

            # small groups side by side: each row with the k-th after it in its group
            end = np.repeat(starts[1:], sizes)
            rows = np.flatnonzero((np.repeat(sizes, sizes) <= FEW) & (np.repeat(sizes, sizes) > 1))
            for k in range(1, FEW):
                rows = rows[rows + k < end[rows]]
                if not len(rows):
                    break
                near = (np.bitwise_count(fp[rows] ^ fp[rows + k]) <= max_bits) & (role[rows] + role[rows + k] >= 1) & (fp[rows] != fp[rows + k])
                joined(at[rows[near]], at[rows[near] + k])
            for g in np.flatnonzero(sizes > FEW):
                own = slice(starts[g], starts[g + 1])
                h, w = np.unique(at[own][role[own] != 0]), np.unique(at[own][role[own] != 1])
                for a, b in close_pairs(names[h], names[w], max_bits):
                    joined(w[a], h[b])
            yield pa.RecordBatch.from_arrays([pa.array(name[np.concatenate(u)]), pa.array(name[np.concatenate(v)])], ["u", "v"])

    return run


def near_links(nodes: DataFrame, max_bits: int = 4, homes: int = HOMES) -> DataFrame:
    """(u, v): links that span, with no others, all links between fingerprints of ``nodes``.

    ``nodes`` has distinct ``fp`` and their ``rep``. Any two fingerprints that differ in at
    most ``max_bits`` bits (62 at most) are connected through the pairs returned, each of which differs in
    no more. Close pairs of large parts are taken before others. One or no rows: an empty table.
    """
    masks = tables_of(max_bits)
    tables = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(masks)])
    placed = nodes.select("fp", "rep", F.explode(tables).alias("t")).select("fp", "rep", "t.part", "t.key")
    # parts and shards larger than a block: a row for some thousands of fingerprints at most
    sizes = placed.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > homes)
    sizes = materialise(sizes.select("part", "key", F.ceil(F.log2(F.col("n") / homes)).cast("int").alias("depth")), "parts")
    plain = placed.select("part", "key", F.lit(0).cast("long").alias("shard"), F.lit(0).alias("hb"), F.lit(0).alias("vb"), F.lit(2).alias("role"), "fp", "rep")
    if not sizes.isEmpty():
        sizes = small(sizes)

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, len(whole), 2048):
                    batch = whole.slice(low, 2048)
                    part, key, depth, fp = (batch.column(c).to_numpy() for c in (0, 1, 2, 3))
                    seed = mixed(key.view(np.uint64) + mixed(part.astype(np.uint64)))
                    row, shard, home = route(fp.view(np.uint64), seed, depth, max_bits)
                    took = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(shard), pa.array(home), took.column(3), took.column(4)], ["part", "key", "shard", "home", "fp", "rep"])

        deep = placed.join(sizes, ["part", "key"]).select("part", "key", "depth", "fp", "rep").mapInArrow(routed, "part int, key long, shard long, home boolean, fp long, rep long")
        keys = ["part", "key", "shard"]
        large = deep.groupBy(*keys).agg(F.count_if("home").alias("nh"), F.count("*").alias("nv")).where((F.col("nh") > homes) | (F.col("nv") > VISITORS))
        large = materialise(large.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("nh") / homes)).cast("int").alias("nh"), F.ceil(F.col("nv") / VISITORS).cast("int").alias("nv")), "shards")
        held = deep.join(small(large), keys, "left").fillna(1, ["nh", "nv"])
        mine = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        role = lambda h, w, r: F.struct(h.cast("int").alias("hb"), w.cast("int").alias("vb"), F.lit(r).alias("role"))
        as_home = F.transform(F.sequence(F.lit(0), F.col("nv") - 1), lambda w: role(mine("nh"), w, 1))
        as_visitor = F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda h: role(h, mine("nv"), 0))
        one = (F.col("nh") == 1) & (F.col("nv") == 1)
        roles = F.when(one & F.col("home"), F.array(role(F.lit(0), F.lit(0), 2))).when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor)
        dealt = held.select(*keys, "fp", "rep", F.explode(roles).alias("r")).select(*keys, "r.*", "fp", "rep")
        plain = plain.join(sizes, ["part", "key"], "left_anti").unionByName(dealt)
    ordered = plain.select(*_PART, "role", "fp", "rep").repartition(*_PART).sortWithinPartitions(*_PART)
    return ordered.mapInArrow(thrifty(_linked(max_bits)), "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id): one row per input row.

    ``fingerprint`` is 16 lower-case hex digits. ``component_id`` is the smallest id that links
    of at most ``max_bits`` differing bits reach, its own included. Equal fingerprints link,
    the zero of texts without words too. Null texts count as empty; rows repeat as given; a
    null id gets its group's smallest id that isn't null (null if there is none). Empty input
    gives an empty table. Other columns of ``docs`` are ignored.
    """
    each = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    known = each.groupBy("fp").agg(F.min("id").alias("least"))
    # a fingerprint whose ids are all null still needs a name of its own to be linked under
    nodes = materialise(known.select("fp", F.coalesce("least", F.col("fp").bitwiseOR(F.lit(-(1 << 63)))).alias("rep"), "least"), "nodes")
    found = components(near_links(nodes, max_bits))
    named = nodes.join(found, nodes.rep == found.node, "left").select("fp", "least", F.coalesce("component", "rep").alias("root"))
    # roots made of bits (negative) sort below ids, so the smallest real id is looked up again
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialise(named.join(lowest, "root").select("fp", "component_id"), "labels")
    return each.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
