"""Quality rules: counts of each text, and lines that too many documents of a host share.

One pass over the texts gives a row of counts and the hashes of the normalised lines. The rest
works on those: per host and line, the number of different texts it is in (copies of a text
count once) is an aggregate combined before the shuffle. Lines above the limit are boilerplate
in all documents of the host but the one with the smallest id (of those whose counts pass); a document that such lines
leave with too few words is depleted and goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL, materialise, release, text_keys, thrifty

#: A line is boilerplate in more than this many different texts of its host, and more than
#: this share of them; a document with fewer words left than FEWEST is depleted.
MOST_TEXTS, MOST_SHARE, FEWEST = 20, 0.005, 10

SYMBOLS = "#*$%&|<>"
WINDOW = 5
_MULTIPLIERS = np.random.default_rng(10).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes]) -> int:
    """Words in WINDOW-word windows that are in ``words`` twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    mixed = sum(ids[k : n + k] * m for k, m in enumerate(_MULTIPLIERS))
    ordered = np.sort(mixed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(mixed, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[at] += 1
    edge[at + WINDOW] -= 1  # the windows' starts differ, so no index is met twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def normal_hash(words: list[bytes]) -> int:
    """The signed hash of a line, without regard to case (A-Z) and white space; Spark's xxhash64 gives the same."""
    h = xxhash.xxh64_intdigest(b" ".join(words).lower(), 42)
    return h - (1 << 64) if h >> 63 else h


def measure(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content, lines, sizes).

    ``lines`` are the hashes of the different normalised lines that have a word, ``sizes`` the
    words of all lines with that hash, ``content`` the hash of all words.
    """
    words: list[bytes] = []
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    dups = 0
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        own = line.split()
        if own:
            dups += line in seen
            seen.add(line)
            words += own
            h = normal_hash(own)
            lines[h] = lines.get(h, 0) + len(own)
    blank = sum(map(text.count, " \t\n\v\f\r"))
    return (
        len(words), len(text) - blank, sum(map(text.count, SYMBOLS)), dups, repeat_words(words),
        normal_hash(words), list(lines), list(lines.values()),
    )


_MEASURED = (
    "id long, k1 long, k2 long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, content long, lines array<long>, sizes array<int>"
)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in _MEASURED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            found = zip(*(measure(t.as_py()) for t in batch.column(4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(found, kinds))], names)


def verdicts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, fewest: int = FEWEST,
) -> DataFrame:
    """One row per input row: id, k1 and k2 (hashes of the text), the counts, base_failed, gone, kept.

    ``gone``: hashes of the document's lines above the limits (null: none); ``kept``: neither
    failed by its counts nor depleted. Null texts count as empty and fail; a null host is a
    host of its own; rows of one id are judged each for itself; a null id never is the one
    document that keeps its lines, unless all are null. Empty input gives an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = docs.select(
        F.col(id_col).cast("long").alias("id"), *text_keys(text),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text.alias("text"),
    )
    measured = chosen.mapInArrow(thrifty(_measure_batches), _MEASURED).withColumn("row", F.monotonically_increasing_id())
    measured = materialise(measured, "measured")

    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    texts = measured.groupBy("host", "content").agg(F.min("row").alias("row"))
    size = texts.groupBy("host").agg(F.count("*").alias("of"))
    # of copies only one counts as a text
    each = measured.join(texts.select("row", F.lit(1).alias("counts")), "row", "left")
    each = each.select("host", "counts", F.when(~base, F.col("id")).alias("id"), F.explode("lines").alias("line"))
    spread = each.groupBy("host", "line").agg(F.sum("counts").alias("texts"), F.min("id").alias("first"))
    common = spread.where(F.col("texts") > most_texts).join(size, "host").where(F.col("texts") > F.col("of") * most_share)
    common = materialise(common.select("host", "line", "first"), "common")

    words = measured.select("row", "id", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("l"))
    words = words.select("row", "id", "host", F.col("l.lines").alias("line"), F.col("l.sizes").alias("words"))
    hit = words.join(common, ["host", "line"]).where(~F.col("id").eqNullSafe(F.col("first")))
    lost = hit.groupBy("row").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("gone"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    out = (
        measured.drop("lines", "sizes", "content", "host")
        .join(lost, "row", "left")
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (left >= fewest))
        .drop("row", "lost")
    )
    out._siftline_path = measured._siftline_path  # what ``release`` deletes once the verdicts have been used
    return out


def digest(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias(id_col), *counts, "base_failed", "kept")


def line_hash(line: Column) -> Column:
    """``normal_hash`` of a line's words, on the JVM; of a line without words that of an empty string."""
    words = F.trim(F.regexp_replace(line, "[ \t\n\u000B\f\r]+", " "))
    return F.xxhash64(F.translate(words, ascii_uppercase, ascii_lowercase))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, with lines above the limits cut from their texts.

    Columns are those of ``docs``, whatever their names; ``n_chars`` is set where it exists and
    the text changed. Null, empty and too repetitive texts go; rows of one id are judged each
    for itself, repeated rows alike. An empty table gives an empty one.

    Rows that go or change are marked by id and text; where those are few the mark goes to the
    texts, so that no text is shuffled, and texts without marks are passed on as they are.
    """
    judged = verdicts(docs, id_col, text_col, host_col, **limits)
    marks = judged.where("NOT kept OR gone IS NOT NULL").groupBy("id", "k1", "k2").agg(F.bool_or("kept").alias("kept"), F.any_value("gone", True).alias("gone"))
    marks = materialise(marks, "marks")
    release(judged)
    size = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("gone")), F.lit(0)).alias("lines")).first()
    if size.n <= SMALL and size.lines <= SMALL:
        marks = F.broadcast(marks)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).cast("long").alias("id"), *text_keys(text)]
    each = docs.select(*keys, text.alias("text"), F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    same = each["id"].eqNullSafe(marks["id"]) & (each["k1"] == marks["k1"]) & (each["k2"] == marks["k2"])
    joined = each.join(marks, same, "left").where(F.coalesce("kept", F.lit(True))).select("text", "row", "gone")
    left = F.filter(F.split("text", "\n"), lambda line: ~F.array_contains("gone", line_hash(line)))
    joined = joined.withColumn("text", F.when(F.col("gone").isNotNull(), F.array_join(left, "\n")))
    new = {c: F.col(f"row.`{c}`") for c in docs.columns}
    changed = F.col("gone").isNotNull()
    new[text_col] = F.when(changed, F.col("text")).otherwise(new[text_col])
    if "n_chars" in new:
        new["n_chars"] = F.when(changed, F.length("text")).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[col.alias(c) for c, col in new.items()])
