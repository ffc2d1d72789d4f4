"""Plain prefix doubling: every byte's position is ranked by sorting rank pairs at growing offsets.

What ``suffix`` replaces, kept as the method in its plain form for small corpora and for comparison:
a position's first rank is its 8 bytes; at each round the pair of a position's rank and that of the
position one offset on is sorted, equal pairs get one rank, and positions whose pair is unique
are dropped, until ranks stand for ``length`` bytes. Each round shuffles every open position three
times, about 24 bytes each, so it needs tens of times the corpus on disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release
from .suffix import _text_bytes

FIRST = 8


def offsets(length: int) -> list[tuple[int, int]]:
    """(length so far, offset of the second rank of a pair) of each round."""
    out, now = [], FIRST
    while now < length:
        step = min(now, length - now)
        out.append((now, step))
        now += step
    return out


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, len(whole), 64):
            batch = whole.slice(low, 64)
            data, bounds = _text_bytes(batch.column(1))
            for i, row in enumerate(batch.column(0).to_pylist()):
                text = data[bounds[i] : bounds[i + 1]]
                if len(text) < FIRST:
                    continue
                rank = np.lib.stride_tricks.sliding_window_view(text, FIRST)
                rank = np.ascontiguousarray(rank).view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), row)), pa.array(np.arange(len(rank))), pa.array(rank)], ["row", "pos", "rank"])


def doubled_windows(texts: DataFrame, length: int = 200) -> DataFrame:
    """(row, pos): the places in (row, text) where a string of ``length`` bytes, a multiple of 8, starts that also starts elsewhere.

    ``row`` is a number that no other row has. Null texts count as empty.
    """
    if length % FIRST:
        raise ValueError(f"length must be a multiple of {FIRST}")
    now = materialise(texts.select("row", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_positions, "row long, pos long, rank long"), "ranks")
    for _, step in offsets(length):
        ahead = now.select("row", (F.col("pos") - step).alias("pos"), F.col("rank").alias("rank2"))
        pairs = now.join(ahead, ["row", "pos"])
        same = Window.partitionBy("rank", "rank2")
        ranked = pairs.select("row", "pos", F.min(F.xxhash64("row", "pos")).over(same).alias("new"), F.count("*").over(same).alias("held"))
        after = materialise(ranked.where("held > 1").select("row", "pos", F.col("new").alias("rank")), "ranks")
        release(now)
        now = after
    return now.select("row", "pos")
