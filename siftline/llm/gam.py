"""Text quality by a generalised additive model with pairwise interactions.

A text becomes a few numbers: shares of letters, capitals, digits and symbols, lengths and
variety of words, repeated lines and windows, how far it compresses. Each number is cut into
bins at quantiles of the training rows, and the model keeps a lookup table over the bins of each
feature and over the pairs of coarse bins of the pairs that help most. The tables are learned by
cyclic boosting: round after round, each feature in turn gets a small step by a shallow tree
over its bins (up to LEAVES leaves), fitted to the gradient of the logistic loss with all tables
so far; then pairs are ranked by what a tree over both could still gain, and the first ones are
boosted in turn in the same way. A text's score is the logistic function of the sum of its table
entries: bins are found and entries added column by column for a batch of texts.

Tables are fitted on the driver to the numbers of at most SAMPLE labelled rows. Texts stay in
tasks: what is sent is a row of numbers for each training text, and the tables.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, thrifty

#: Labelled rows that the tables are fitted to, at most.
SAMPLE = 20_000
#: Bins of a feature, coarse bins of a feature in a pair, pairs, leaves of a tree over one feature.
BINS, COARSE, PAIRS, LEAVES = 32, 8, 8, 3
#: Rounds over all features and over all pairs, the step of a round, and what pulls leaves to zero.
ROUNDS, PAIR_ROUNDS, STEP, PULL = 200, 60, 0.1, 2.0
#: Bytes of a text that are looked at at once (all of them are).
PIECE = 1 << 20
#: Words in a window that may repeat.
WINDOW = 5

FEATURES = (
    "words", "chars_per_word", "letters", "capitals", "digits", "symbols", "ends", "pauses", "exclamations", "beyond_ascii", "control",
    "entropy", "distinct_words", "commonest_word", "single_chars", "long_words", "lines", "words_per_line", "repeated_lines",
    "repeated_windows", "packed",
)
_CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789",
    "symbols": b"#*$%&|<>@^~{}[]\\/=_+`", "ends": b".?", "pauses": b",;:", "exclamations": b"!",
}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES.values()):
    _CLASS[list(_chars), _k] = 1


def features(text: str | None) -> list[float]:
    """The numbers of one whole text, in the order of FEATURES; of a null or empty text all are 0.

    Words are runs without the space and the controls 09 to 0D; shares of characters are shares
    of UTF-8 bytes.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts, packed, press = np.zeros(256), 0, zlib.compressobj(1)
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        counts += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        packed += len(press.compress(piece))
    packed += len(press.flush())
    n, total = len(words), len(raw)
    letters, capitals, digits, symbols, ends, pauses, exclamations = (counts @ _CLASS).tolist()
    share = counts[counts > 0] / total
    lengths = np.fromiter(map(len, words), np.int64, n)
    names, name, times = np.unique(np.fromiter(map(hash, words), np.int64, n), return_inverse=True, return_counts=True)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = repeated = 0
    if n >= WINDOW:
        key = np.zeros(n - WINDOW + 1, np.uint64)
        for k in range(WINDOW):  # places of words in a list, so a window's key is no accident of their bytes
            key = key * np.uint64(0x9E3779B97F4A7C15) + name[k : n - WINDOW + 1 + k].astype(np.uint64)
        windows = len(key)
        repeated = windows - len(np.unique(key))
    return [
        np.log2(1 + n), (total - counts[9:14].sum() - counts[32]) / n, letters / total, capitals / max(1.0, letters), digits / total, symbols / total,
        ends / n, pauses / n, exclamations / n, counts[128:].sum() / total, (counts[:9].sum() + counts[14:32].sum() + counts[127]) / total,
        float(-(share * np.log2(share)).sum()), len(names) / n ** 0.8, times.max() / n, float((lengths == 1).mean()), float((lengths > 20).mean()),
        np.log2(1 + len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), repeated / max(1, windows), packed / total,
    ]


@dataclass
class Model:
    """Tables over bins: ``score = 1 / (1 + exp(-(base + sum of tables)))``."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Rows of features to scores from 0 to 1."""
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins: halfway between neighbours at quantiles, where they differ."""
    values, places = np.unique(x), np.sort(x)
    at = places[np.unique((np.arange(1, bins) * len(x)) // bins)]
    above = values[np.minimum(np.searchsorted(values, at, "right"), len(values) - 1)]
    return np.unique((at + above)[above > at] / 2)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PULL)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Steps for each bin by a tree of up to LEAVES leaves over bins with gradients g and curvatures h: the best cuts, one after another."""
    cuts = [0, len(g)]
    G, H = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    for _ in range(LEAVES - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            m = np.arange(a + 1, b)
            if len(m):
                gain = _gain(G[m] - G[a], H[m] - H[a]) + _gain(G[b] - G[m], H[b] - H[m]) - _gain(G[b] - G[a], H[b] - H[a])
                if gain.max() > best:
                    best, where = gain.max(), int(m[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    leaves = np.array([(G[b] - G[a]) / (H[b] - H[a] + PULL) for a, b in zip(cuts, cuts[1:])])
    return np.repeat(leaves, np.diff(cuts))


def shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """(steps for each pair of bins, gain) by the best of the trees that cut one feature and then, on each side, the other."""
    best, steps = 0.0, np.zeros_like(g)
    whole = _gain(g.sum(), h.sum())
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        for m in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), -whole
            for rows in (slice(0, m), slice(m, None)):
                G, H = np.cumsum(gg[rows].sum(axis=0)), np.cumsum(hh[rows].sum(axis=0))
                both = _gain(G[:-1], H[:-1]) + _gain(G[-1] - G[:-1], H[-1] - H[:-1])
                k = int(both.argmax()) + 1 if len(both) else len(G)
                gain += both[k - 1] if len(both) else _gain(G[-1], H[-1])
                out[rows, :k] = G[k - 1] / (H[k - 1] + PULL)
                if k < len(G):
                    out[rows, k:] = (G[-1] - G[k - 1]) / (H[-1] - H[k - 1] + PULL)
            if gain > best:
                best, steps = gain, out.T if turn else out
    return steps, best


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> Model:
    """The tables for rows ``x`` with labels ``y`` (0 or 1). With one kind of label, or none, tables are empty."""
    edges = [_edges(x[:, k], BINS) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    coarse = [_edges(x[:, k], COARSE) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if not 0 < y.sum() < len(y):
        return model
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slopes()
                step = STEP * shallow_tree(np.bincount(bins[k], g, len(table)), np.bincount(bins[k], h, len(table)))
                table += step
                total += step[bins[k]]
    rough = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]

    def cells(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        cell = rough[a] * shape[1] + rough[b]
        return cell, *(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    ranked = sorted(((shallow_pair_tree(*cells(a, b, g, h)[1:])[1], -a, -b) for a, b in itertools.combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(-a, -b) for gain, a, b in ranked[:pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            cell, gg, hh = cells(a, b, g, h)
            step = STEP * shallow_pair_tree(gg, hh)[0]
            table += step
            total += step.ravel()[cell]
    return model


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[1:], "x"])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(0)], float).reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.scores(x))], ["id", "score"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of at most ``sample`` labelled rows that aren't held out; copies of a text with one label count once."""
    known = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("y")).where("lid IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(F.col("lid"))).orderBy(F.xxhash64("lid"), "lid", "y").limit(sample)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most ``sample`` rows of two numbers are broadcast
    chosen = plain.join(F.broadcast(known), plain["id"] == known["lid"]).select("text", "y", F.xxhash64("text").alias("h"))
    table = materialise(chosen.mapInArrow(thrifty(_numbers), "y int, h long, x array<double>"), "training")
    # an id may stand for several rows, so the bound is set again
    rows = table.dropDuplicates(["h", "y"]).orderBy("h", "y").limit(sample).select("x", "y").collect()
    release(table)
    return np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float)


def held_out(column):
    """Whether an id's row is kept from learning: crc32 of its decimal digits mod 3 is 1. A null id isn't."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> DataFrame:
    """(id_col, held_out, score, predicted): one row per row of ``docs``.

    Tables are learned from at most ``sample`` rows of ``labels`` (by a hash of their ids) that
    aren't held out. Labels and other columns of ``docs`` are no inputs of a score: it depends on
    the whole text alone. Null, empty and blank texts have the same numbers (all 0) and so the same
    score. Labels other than 0 and 1 and null ones are not learned from; without usable labels
    every score is 0.5, with one kind of label the smoothed rate of it. Repeated rows each come
    out; copies of a text count once in learning. Of equal ids each row is scored by its own text.
    """
    model = fit(*training_rows(docs, labels, id_col, text_col, label_col, sample))
    plain = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    out = plain.mapInArrow(thrifty(_scored(model)), "id long, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
