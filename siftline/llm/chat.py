"""Chat formatting in budgeted windows.

A window is a span of new turns, before it the system turn and, as far as the budget allows, up to
``history`` tokens of the turns just before, which are repeats and are masked; each assistant
turn is a target in exactly one window. A span has the budget less the system turn and the
history, and ends only where the next turn doesn't fit, so a window exceeds the budget only if its
system turn and one other turn do by themselves.

Where a span ends depends on where it began, which would make a conversation one long chain. So turns go in
blocks: what a block does to each number of tokens that an open span can bring along is worked
out for all blocks at once, the blocks' answers are followed from the conversation's start (a row
per block), and then each block is cut by itself. Prefix sums, which tell what is near enough to
repeat, are made in two levels as well (within blocks, and over the blocks' totals). So a
very long conversation is no single task's until its windows are read back for a digest, one
after another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, thrifty

#: The template: strings that mark turns, and no text holds without an escape (fixed values).
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
TURN, HEAD = "[TURN]", "[/TURN]"
_CONTROL = "|".join(map(re.escape, (BEGIN, END, OPEN, CLOSE, TURN, HEAD)))
_ESCAPE = re.compile(rf"\\|{_CONTROL}")
_SCAN = re.compile(rf"\\(\\|{_CONTROL})|({_CONTROL})")
#: Tokens in a window, tokens of repeated history, turns in a block.
BUDGET, HISTORY, BLOCK = 512, 128, 1024
ROLES = ("system", "user", "assistant")


def escape(text: str) -> str:
    """The text with a backslash before each control string and each backslash."""
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _SCAN.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted, mask) of (role, text, whether it is a repeat): mask has the code points
    (start, end) of the new assistant texts.

    A turn is ``[TURN]role[/TURN]text``, a user's text within ``[INST] [/INST]``.
    """
    parts, mask, at = [BEGIN], [], len(BEGIN)
    for role, text, repeat in turns:
        head = f"{TURN}{escape(role)}{HEAD}" + (OPEN if role == "user" else "")
        body = escape(text)
        start = at + len(head)
        if role == "assistant" and not repeat:
            mask.append((start, start + len(body)))
        parts += (head, body, CLOSE if role == "user" else "")
        at = start + len(body) + len(parts[-1])
    parts.append(END)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    parts: list[list[str]] = []
    at, plain, role = 0, [], None
    for m in _SCAN.finditer(formatted):
        plain.append(formatted[at : m.start()] + (m[1] or ""))
        at = m.end()
        if m[2] is None:
            continue
        if m[2] in (TURN, END):
            if role is not None:
                parts.append([role, "".join(plain)])
            plain, role = [], None
        elif m[2] == HEAD:
            role, plain = "".join(plain), []
        elif m[2] in (OPEN, CLOSE, BEGIN):
            if m[2] == BEGIN:
                plain = []
    return [(r, t) for r, t in parts]


def words_and_marks(text: Column) -> Column:
    """What a turn counts for if no tokenizer is given: its words, and 4 for the marks around it."""
    return F.size(F.split(F.trim(text), r"\s+")).cast("long") + 4


def _followed(sizes: list[int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number of tokens, 0 to ``room``, in the open span before a block: (their number after it, place of the last span's first turn or -1)."""
    held, first = np.arange(room + 1), np.full(room + 1, -1)
    for k, n in enumerate(sizes):
        new = (held == 0) | (held + n > room)
        first[new] = k
        held = np.minimum(np.where(new, n, held + n), room)
    return held, first


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The sorted rows of a task, one run of equal first ``keys`` columns after another."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        cuts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns], axis=0)) + 1).tolist(), len(batch)] if len(batch) else [0]
        for low, high in zip(cuts, cuts[1:]):
            part = batch.slice(low, high - low)
            if held and any(held[-1].column(c)[-1].as_py() != part.column(c)[0].as_py() for c in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _block_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _runs(batches, 2):
        conv, block, room = (table.column(c)[0].as_py() for c in ("conv", "block", "room"))
        held, first = _followed(table.column("n_tokens").to_pylist(), room)
        pos = table.column("pos").to_numpy()
        first = np.where(first >= 0, pos[first], -1)
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([block]), pa.array([held.astype(np.int32)]), pa.array([first])], ["conv", "block", "held", "first"])


def _followed_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, held, first): the open span before each block, its tokens and first turn."""
    conv, held, first = None, 0, -1
    for batch in batches:
        out = []
        for c, block, after, starts in zip(*(batch.column(k) for k in range(4))):
            if c.as_py() != conv:
                conv, held, first = c.as_py(), 0, -1
            out.append((conv, block.as_py(), held, first))
            begun = starts.values[held].as_py()
            held, first = after.values[held].as_py(), begun if begun >= 0 else first
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["conv", "block", "held", "first"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``span``: the place of the first turn of the span that each turn is in."""
    now, held, first = None, 0, -1
    for batch in batches:
        spans = []
        for c, b, pos, n, room, h, f in zip(*(batch.column(k).to_pylist() for k in ("conv", "block", "pos", "n_tokens", "room", "held", "first"))):
            if (c, b) != now:
                now, held, first = (c, b), h, f
            if not held or held + n > room:
                held, first = 0, pos
            held = min(held + n, room)
            spans.append(first)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.int64())], [*batch.schema.names, "span"])


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``turns`` (conv, pos, role, text, n_tokens) with ``before`` (tokens of earlier turns), ``lead`` (tokens of the conversation's system turn) and ``span``."""
    within = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tagged = turns.withColumn("block", F.floor(F.col("pos") / BLOCK))
    sums = tagged.groupBy("conv", "block").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    system = turns.where("role = 'system'").groupBy("conv").agg(F.min_by("n_tokens", "pos").alias("lead"))
    sums = sums.withColumn("base", F.coalesce(F.sum("total").over(earlier), F.lit(0))).join(system, "conv", "left")
    lead = F.coalesce("lead", F.lit(0))
    sums = materialise(sums.select("conv", "block", "base", lead.alias("lead"), F.greatest(F.lit(1), F.lit(budget) - lead - history).alias("room")), "blocks")
    # conversations of one block begin with no open span; of the others each block's function is worked out
    long = sums.where("block > 0").select("conv").distinct()
    functions = tagged.select("conv", "block", "pos", "n_tokens").join(long, "conv", "left_semi").join(sums, ["conv", "block"]).select("conv", "block", "pos", "n_tokens", "room")
    functions = functions.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos").mapInArrow(_block_functions, "conv long, block long, held array<int>, first array<long>")
    opens = functions.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_followed_blocks, "conv long, block long, held long, first long")
    sums = sums.join(materialise(opens, "opens"), ["conv", "block"], "left").fillna(0, ["held"]).fillna(-1, ["first"])
    # one shuffle serves the window, the join and the cut
    joined = tagged.repartition("conv", "block").withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, ["conv", "block"])
    names = ["conv", "block", "pos", "role", "text", "n_tokens", "room", "held", "first", "lead"]
    each = joined.select(*names, (F.col("base") + F.col("inner")).alias("before")).sortWithinPartitions("conv", "block", "pos")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in each.schema.fields)
    return each.mapInArrow(thrifty(_cut), f"{kinds}, span long").select("conv", "pos", "role", "text", "n_tokens", "lead", "before", "span")


def windows(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = words_and_marks,
) -> DataFrame:
    """(conv_col, window, first_pos, repeats, formatted, mask): the training windows.

    ``window`` is the place of its first new turn in the conversation, from 0;
    ``repeats``: how many turns at the window's front were in an earlier one; ``mask``: (start,
    end) in code points of ``formatted``, of each new assistant text. Turns are ordered by turn,
    then role and text (nulls first), so ties and repeated rows have a fixed order and all are
    kept. Null texts and roles count as empty. A system turn is one whose role is ``system``; the
    first is repeated. Rows without a conversation id make one conversation. No rows: no windows. ``tokens``
    gives the number of tokens, 1 or more, of a turn's text.
    """
    rows = conversations.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("n_tokens", tokens(F.col("text")).cast("long"))
    order = ["turn", "role", "text"]
    # positions in two levels too: rows before in the block of turn numbers, and in earlier ones
    shelf = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60)))
    rows = rows.withColumn("shelf", shelf)
    sizes = rows.groupBy("conv", "shelf").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv").alias("c"), F.col("shelf").alias("s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "shelf").orderBy(*order)) - 1)
    placed = placed.join(sizes, placed["conv"].eqNullSafe(sizes["c"]) & (placed["shelf"] == sizes["s"]))
    placed = placed.withColumn("pos", F.col("base") + F.col("rank")).select(F.coalesce("conv", F.lit(-(1 << 63))).alias("conv"), "pos", "role", "text", "n_tokens")
    # read five times from here on, so worked out once
    turns = materialise(spans(placed, budget, history), "turns")

    begins = turns.groupBy("conv", "span").agg(F.min("pos").alias("first_pos"), F.min("before").alias("start"), F.sum("n_tokens").alias("tokens"), F.any_value("lead").alias("lead"))
    # what system turn and span leave of the budget, for what is repeated
    begins = begins.withColumn("room", F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("lead") - F.col("tokens"))))
    system = turns.where("role = 'system'").groupBy("conv").agg(F.min_by(F.struct("pos", "role", "text"), "pos").alias("sys"))
    # a turn is history of a later span if what lies between its start and the span's is small
    # enough; two spans in a row hold more than the budget leaves, so few spans can be near enough
    own = turns.select("conv", "span", F.struct("pos", "role", "text", F.lit(False).alias("repeat")).alias("t"))
    past = turns.select("conv", "pos", "role", "text", F.col("before").alias("b"), F.col("span").alias("of"))
    stretch = F.sequence(F.floor(F.col("b") / budget), F.floor((F.col("b") + history) / budget))
    past = past.withColumn("cell", F.explode(stretch))
    later = begins.withColumn("cell", F.floor(F.col("start") / budget))
    past = past.join(later, ["conv", "cell"]).where((F.col("of") < F.col("span")) & (F.col("b") >= F.col("start") - F.col("room")))
    past = past.select("conv", "span", F.struct("pos", "role", "text", F.lit(True).alias("repeat")).alias("t"))
    lead = begins.join(system, "conv").where(F.col("sys.pos") < F.col("first_pos"))
    lead = lead.select("conv", "span", F.struct("sys.pos", "sys.role", "sys.text", F.lit(True).alias("repeat")).alias("t"))
    held = own.union(past).union(lead).groupBy("conv", "span").agg(F.array_sort(F.collect_set("t")).alias("turns"))

    @F.pandas_udf(T.StructType([T.StructField("formatted", T.StringType()), T.StructField("mask", T.ArrayType(T.ArrayType(T.IntegerType())))]))
    def made(turns: pd.Series) -> pd.DataFrame:
        out = [format_turns([(t["role"], t["text"], t["repeat"]) for t in each]) for each in turns]
        return pd.DataFrame({"formatted": [f for f, _ in out], "mask": [[list(s) for s in m] for _, m in out]})

    out = held.select("conv", "span", F.size(F.filter("turns", lambda t: t["repeat"])).alias("repeats"), F.filter("turns", lambda t: ~t["repeat"])[0]["pos"].alias("first_pos"), made("turns").alias("m"))
    conv = F.when(F.col("conv") != -(1 << 63), F.col("conv")).alias(conv_col)
    return out.select(conv, F.col("span").alias("window"), "first_pos", "repeats", "m.formatted", "m.mask")


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): one row per
    conversation, of what is parsed from the strings of its ``windows``.

    Windows are taken in order, one at a time, so a task holds no conversation as a whole.
    Windows without a conversation id are one conversation. No windows: an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows = [(conv, n, turns.hexdigest(), chars, loss.hexdigest(), size) for conv, n, turns, chars, loss, size in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], [conv_col, *(p.split()[0] for p in _DIGEST.split(", "))])

        for batch in batches:
            for conv, repeats, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                new = parse_turns(text)[repeats:]
                now[1] += len(new)
                now[2].update("".join(f"{role}\n{body}\n" for role, body in new).encode())
                loss = "".join(unescape(text[a:b]) for a, b in mask)
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(text)
            if len(done) > 5_000:
                yield out()
        if now is not None:
            done.append(now)
        yield out()

    ordered = formatted.repartition(conv_col).sortWithinPartitions(conv_col, "first_pos")
    return ordered.select(conv_col, "repeats", "formatted", "mask").mapInArrow(thrifty(run), f"`{conv_col}` long, {_DIGEST}")


def with_probe(conversations: DataFrame) -> DataFrame:
    """``conversations`` and conversation -1, whose texts hold the template's own strings."""
    probe = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").union(probe)


def brute_force(turns: list[tuple[str | None, str | None]]) -> tuple[int, str, int, str]:
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of one conversation (for tests)."""
    body = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()
