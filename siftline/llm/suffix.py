"""Repeated byte strings, found by refining the ranks of sampled positions.

Plain prefix doubling (``doubling``) sorts a pair of ranks for each byte of a corpus at each offset,
which costs many times the corpus in shuffles. Here no pairs are sorted and no offsets doubled:
positions are sampled first, in a way that loses nothing, and only theirs are ranked. Every string of
``length`` bytes (a *window*) is assigned to the smallest hash among the ``length // 4``-byte
strings inside it, the leftmost of equals: its *anchor*. Equal windows have equal anchors at
equal offsets, so windows only have to be compared within anchors of one rank, and an anchor is
assigned a run of consecutive windows (about 70 for 200 bytes).

The rank of an anchor is the class of its ``length // 4`` bytes. Ranks are then refined
at growing lengths (50, 169, 193, 200 bytes for 200): the string that all
windows of a run share is extended to both sides, and the pair of (rank so far, extension)
makes the next rank. A rank held once is unique and is dropped; a rank whose members agree on
everything their runs cover is decided as a whole; the others split into shorter runs, until a
run is one window and its rank is the class of the whole ``length`` bytes. Ranks are 64-bit hashes
of 64-bit hashes and the bytes added; a false match needs a collision within one earlier rank.

Only aggregates of a rank (count, least, greatest) are shuffled, combined before the shuffle, so
a passage in a third of all documents is no hot task; of members that agree in full one
represents the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL, materialise, thrifty

#: Bytes hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 19
#: Widths of the runs of windows at which ranks are refined.
WIDTHS = (32, 8, 1)

_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _POWERS:
        n = PIECE + 4096
        for way, step in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, step, np.uint64)
            steps[0] = 1
            _POWERS[way] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["byte"] = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _POWERS["up"], _POWERS["down"], _POWERS["byte"]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def anchors_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(doc index, first window, number of windows, anchor, rank, hash of all covered bytes).

    ``data`` holds the texts' bytes one after another, text i at starts[i]:ends[i]. Windows do
    not cross texts. Positions are in ``data``.
    """
    k = max(1, length // 4)
    span, n = length - k + 1, len(data)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if n < length:
        return none
    up, down, byte = _powers()
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(byte[data] * up[:n], out=total[1:])
    rank = _mix((total[k:] - total[:-k]) * down[: n - k + 1])
    key = (rank & ~_LOW) | np.arange(len(rank), dtype=np.uint64)
    n_win = n - length + 1
    blocks = -(-len(key) // span)
    grid = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(key)] = key
    grid = grid.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n_win], ahead[span - 1 : span - 1 + n_win]) & _LOW).astype(np.int64)
    edge = np.zeros(n_win + 1, np.int64)
    long = ends - starts >= length
    edge[starts[long]] += 1
    edge[ends[long] - length + 1] -= 1
    window = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(window):
        return none
    at = at[window]
    doc = np.searchsorted(starts[long], window, "right") - 1
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate((first, [len(window)])))
    begin, anchor = window[first], at[first]
    stop = begin + count - 1 + length
    whole = _mix((total[stop] - total[begin]) * down[begin] + ((anchor - begin).astype(np.uint64) << np.uint64(20)) + count.astype(np.uint64))
    return np.flatnonzero(long)[doc[first]], begin, count, anchor, rank[anchor], whole


def _pieces(sizes: np.ndarray, length: int, piece: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Texts grouped to about ``piece`` bytes; a longer text alone, in pieces that overlap."""
    docs, lows, highs, held = [], [], [], 0
    for i, size in enumerate(sizes.tolist()):
        if size < length:
            continue
        if size > piece:
            for low in range(0, size - length + 1, piece - length + 1):
                yield [i], [low], [min(size, low + piece)]
                if low + piece >= size:
                    break
            continue
        if held + size > piece:
            yield docs, lows, highs
            docs, lows, highs, held = [], [], [], 0
        docs.append(i), lows.append(0), highs.append(size)
        held += size
    if docs:
        yield docs, lows, highs


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets), null as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets


_ANCHOR = "id long, tx long, rank long, whole long, start int, count int, offset int, copies int"


def _find_anchors(length: int, piece: int):
    names = [part.split()[0] for part in _ANCHOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_bytes(batch.column(2))
            for docs, lows, highs in _pieces(np.diff(offsets), length, piece):
                cut = [data[offsets[i] + a : offsets[i] + b] for i, a, b in zip(docs, lows, highs)]
                ends = np.cumsum([len(x) for x in cut])
                starts = ends - [len(x) for x in cut]
                joined = np.concatenate(cut) if len(cut) > 1 else cut[0]
                doc, begin, count, anchor, rank, whole = anchors_of(joined, starts, ends, length)
                if not len(doc):
                    continue
                # runs that agree in full within one text: one stands for all, the others are
                # repeats already and are sent as covered stretches (no rank)
                _, group, times = np.unique(np.stack((doc.astype(np.uint64), rank, whole)), axis=1, return_inverse=True, return_counts=True)
                group = group.ravel()
                copies = times[group]
                head = np.zeros(len(doc), bool)
                head[np.unique(group, return_index=True)[1]] = True
                keep = (copies == 1) | head
                rest = np.flatnonzero(copies > 1)
                if len(rest):
                    joins = np.concatenate(([False], (rest[1:] == rest[:-1] + 1) & (begin[rest[1:]] == begin[rest[:-1]] + count[rest[:-1]]) & (doc[rest[1:]] == doc[rest[:-1]])))
                    lead = np.flatnonzero(~joins)
                    sure_begin, sure_doc = begin[rest[lead]], doc[rest[lead]]
                    sure_count = np.add.reduceat(count[rest], lead)
                else:
                    sure_begin = sure_doc = sure_count = np.zeros(0, np.int64)
                shift = np.array(lows, np.int64) - starts
                where = np.concatenate((doc[keep], sure_doc))
                rows = pa.array(np.array(docs, np.int64)[where])
                lead_in = np.concatenate((begin[keep], sure_begin)) + shift[where]
                known = np.concatenate((np.zeros(keep.sum(), bool), np.ones(len(sure_doc), bool)))
                pad = np.zeros(len(sure_doc), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows), batch.column(1).take(rows),
                        pa.array(np.concatenate((rank[keep].view(np.int64), pad)), mask=known),
                        pa.array(np.concatenate((whole[keep].view(np.int64), pad)), mask=known),
                        pa.array(lead_in.astype(np.int32)),
                        pa.array(np.concatenate((count[keep], sure_count)).astype(np.int32)),
                        pa.array(np.concatenate(((anchor - begin)[keep], pad)).astype(np.int32)),
                        pa.array(np.concatenate((copies[keep], pad + 2)).astype(np.int32)),
                    ],
                    names,
                )

    return run


_NODE = "id long, tx long, at int, lo int, hi int, base int, rank long, left binary, right binary"


def _cut_nodes(length: int, width: int):
    """Runs of at most ``width`` windows from texts and the anchors that are still open.

    A window that begins l bytes before the anchor is called l; a node holds windows lo..hi of
    the aligned stretch base..base+width-1. Its rank is of the anchor's rank, base and the
    bytes that all windows of the stretch share; left and right are the rest, as far as there
    is text.
    """
    import xxhash

    names = [part.split()[0] for part in _NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_bytes(batch.column(2))
            lists = batch.column(3)
            n_open = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            rank, start, count, offset = (flat.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("rank", "start", "count", "offset"))
            out: list[list] = [[] for _ in range(8)]
            k = 0
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                for _ in range(n_open[i]):
                    at, high = start[k] + offset[k], offset[k]
                    low = high - count[k] + 1
                    for base in range(low - low % width, high + 1, width):
                        far = base + width - 1
                        core = text[at - base : at + length - far]
                        made = xxhash.xxh64_intdigest(core, (rank[k] + base * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
                        row = (i, at, max(low, base), min(high, far), base, made - (1 << 64) if made >> 63 else made, text[max(0, at - far) : at - base], text[at + length - far : at + length - base])
                        for into, value in zip(out, row):
                            into.append(value)
                    k += 1
                if len(out[0]) > 20_000:
                    yield made_batch(batch, out)
                    out = [[] for _ in range(8)]
            if out[0]:
                yield made_batch(batch, out)

    def made_batch(batch: pa.RecordBatch, out: list[list]) -> pa.RecordBatch:
        rows = pa.array(out[0], pa.int64())
        kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x, t) for x, t in zip(out[1:], kinds))], names)

    return run


def _same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["tx"] == b["tx"])


def _settle(rows: DataFrame, whole: Column, copies: Column, label: str) -> DataFrame:
    """``rows`` whose rank is held more than once, with ``agreed``: all members cover the same."""
    held = (
        rows.select("rank", whole.alias("w"), copies.alias("c"))
        .groupBy("rank")
        .agg(F.sum("c").alias("held"), F.min("w").alias("w0"), F.max("w").alias("w1"))
        .where("held > 1")
        .select("rank", (F.col("w0") == F.col("w1")).alias("agreed"))
    )
    return materialise(rows.join(held, "rank"), label)


def _split(mixed: DataFrame, wide: int, width: int) -> DataFrame:
    """Runs of ``width`` within runs of ``wide``: the next rank is of (rank, extension)."""
    parts = mixed.withColumn("b", F.explode(F.sequence(F.col("base"), F.col("base") + (wide - width), F.lit(width))))
    parts = parts.where((F.col("b") <= F.col("hi")) & (F.col("b") + (width - 1) >= F.col("lo")))
    grow_left = F.col("b") - F.col("base")
    grow_right = F.lit(wide - width) - grow_left
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    cut = lambda c, at, n: F.substring(c, at, n)
    return parts.select(
        "id", "tx", "at",
        F.greatest("lo", "b").alias("lo"), F.least(F.col("hi"), F.col("b") + (width - 1)).alias("hi"),
        F.col("b").alias("base"),
        F.xxhash64("rank", "b", cut(F.col("left"), n_left - grow_left + 1, grow_left), cut(F.col("right"), F.lit(1), grow_right)).alias("rank"),
        cut(F.col("left"), F.greatest(F.lit(1), n_left - grow_left - (width - 1) + 1), F.least(n_left - grow_left, F.lit(width - 1))).alias("left"),
        cut(F.col("right"), grow_right + 1, F.least(n_right - grow_right, F.lit(width - 1))).alias("right"),
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, piece: int = PIECE) -> DataFrame:
    """(id, tx, spans): for each text that has any, the stretches of bytes that repeat.

    ``spans`` is an array of (start, end) in bytes, in no order, which may overlap; ``tx`` is a
    hash of the text, so rows of one id with different texts stay apart.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    anchors = materialise(plain.mapInArrow(thrifty(_find_anchors(length, piece)), _ANCHOR), "anchors")
    ranked = _settle(anchors.where("rank IS NOT NULL"), F.col("whole"), F.col("copies"), "ranked")

    # among ranks whose members differ, those that agree in full with another are repeats too;
    # one of each kind goes on, as what the others may share a part with
    mixed = ranked.where("NOT agreed")
    kinds = materialise(
        mixed.groupBy("rank", "whole").agg(
            F.sum("copies").alias("held"),
            F.min_by(F.struct("id", "tx", "start", "count", "offset"), F.struct("tx", "start")).alias("one"),
        ),
        "kinds",
    )
    again = mixed.join(kinds.where("held > 1").select("rank", "whole"), ["rank", "whole"], "left_semi")
    open_ = kinds.select("one.id", "one.tx", F.struct("rank", "one.start", "one.count", "one.offset").alias("a"))
    open_ = open_.groupBy("id", "tx").agg(F.collect_list("a").alias("open"))
    width = WIDTHS[0]
    nodes = (
        plain.join(open_, _same_text(plain, open_))
        .select(plain["id"], plain["tx"], "text", "open")
        .mapInArrow(thrifty(_cut_nodes(length, width)), _NODE)
    )
    covered = [
        anchors.where("rank IS NULL").select("id", "tx", "start", "count"),
        ranked.where("agreed").select("id", "tx", "start", "count"),
        again.select("id", "tx", "start", "count"),
    ]
    for narrower in (*WIDTHS[1:], None):
        settled = _settle(nodes, F.xxhash64("left", "right", "lo", "hi"), F.lit(1), "nodes")
        sure = settled.where("agreed") if narrower else settled
        covered.append(sure.select("id", "tx", (F.col("at") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + 1).alias("count")))
        if narrower:
            nodes = _split(settled.where("NOT agreed"), width, narrower)
            width = narrower
    found = covered[0]
    for more in covered[1:]:
        found = found.union(more)
    span = F.struct("start", (F.col("start") + F.col("count") + (length - 1)).alias("end"))
    return found.groupBy("id", "tx").agg(F.collect_list(span).alias("spans"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union; stretches that touch make one run."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, piece: int = PIECE) -> DataFrame:
    """(id_col, n_bytes, spans, kept): one row per input row.

    ``spans``: the maximal runs of bytes covered by a string of ``length`` bytes that also
    starts anywhere else, in the same text or another; ``kept``: the other bytes (binary, as
    runs may cut a character). Strings are judged on the input. Null texts count as empty;
    texts shorter than ``length`` keep all; repeated rows repeat each other, so all that they
    have from ``length`` bytes on goes; a null id is allowed. Other columns are ignored.
    """
    spans = repeated_spans(docs, id_col, text_col, length, piece)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tx"), text.alias("text"))
    joined = plain.join(spans, _same_text(plain, spans), "left").select(plain["id"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text_bytes(batch.column(1))
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            flat = lists.flatten()
            base = bounds[0] if len(bounds) else 0
            start, end = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
            runs, kept = [], []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                a, b = bounds[i] - base, bounds[i + 1] - base
                if a == b:
                    runs.append([]), kept.append(text)
                    continue
                s, e = (x.tolist() for x in merged(start[a:b], end[a:b]))
                runs.append([{"start": x, "end": y} for x, y in zip(s, e)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(runs, kind), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def digest(dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sizes, number of runs and the digest of the bytes kept, of ``drop_repeats``' rows."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return dropped.select(
        id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """What ``digest`` gives, by a table of all strings of ``length`` bytes (for tests)."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """``docs`` with repeated stretches cut from the texts; ``n_chars`` is set where it exists.

    The columns and rows are those given, whatever the columns' names. A character that a run
    cuts through goes as a whole; a null text stays null, an empty one empty; repeated rows
    repeat each other; null ids are allowed; an empty table gives an empty one. ``docs`` is
    read three times. Texts without repeats pass as they are.
    """
    spans = materialise(repeated_spans(docs, id_col, text_col, length), "spans")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("tx"), text.alias("text"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    joined = each.join(_near(spans), _same_text(each, spans), "left").select("text", "row", "spans")

    @F.pandas_udf(T.StringType())
    def cut(texts, lists):
        out = []
        for text, spans in zip(texts, lists):
            if spans is not None and len(spans):
                raw = text.encode()
                s, e = (x.tolist() for x in merged(np.array([x["start"] for x in spans]), np.array([x["end"] for x in spans])))
                text = b"".join(raw[x:y] for x, y in zip([0, *e], [*s, len(raw)])).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    # of texts that stay only their row goes on; the others' alone are sent to Python
    changed = F.col("spans").isNotNull()
    joined = joined.withColumn("text", cut(F.when(changed, F.col("text")).otherwise(""), F.col("spans")))
    new = {c: F.col(f"row.`{c}`") for c in docs.columns}
    new[text_col] = F.when(changed, F.col("text")).otherwise(new[text_col])
    if "n_chars" in new:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[col.alias(c) for c, col in new.items()])


def _near(spans: DataFrame) -> DataFrame:
    """``spans``, to be broadcast if they are few, so that no text is shuffled."""
    size = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("all")).first()
    return F.broadcast(spans) if size.n + size.all <= SMALL else spans
