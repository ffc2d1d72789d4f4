"""Shapes of lines: tallies, candidates for rules, and lines around an anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import NS, WS, bind
from . import filtering


def tally(shaped: DataFrame) -> DataFrame:
    """(program, template, lines, hosts, n_days, example, example_host) of ``templates``' rows."""
    first = F.min(F.struct("log_date", "line_no", "raw", "host"))
    groups = shaped.where("template IS NOT NULL").groupBy("program", "template").agg(
        F.count("*").alias("lines"), F.count_distinct("host").alias("hosts"), F.count_distinct("log_date").alias("n_days"), first.alias("f")
    )
    return groups.select("program", "template", "lines", "hosts", "n_days", F.col("f.raw").alias("example"), F.col("f.host").alias("example_host"))


def candidates(tallied: DataFrame, scores: DataFrame, threshold: float = 0.2, min_days: int = 3, min_lines: int = 10) -> DataFrame:
    """Frequent shapes of little interest, by (program, template, score)."""
    joined = tallied.join(scores, ["program", "template"])
    found = joined.where((F.col("score") < threshold) & (F.col("n_days") >= min_days) & (F.col("lines") >= min_lines))
    return found.orderBy(F.desc("lines"), "program", "template")


def unreviewed(pool: DataFrame, verdicts: DataFrame, since: str, rules: list = ()) -> DataFrame:
    """Shapes without a verdict on or after a day, whose example none of the ``rules`` drops already."""
    if rules:
        pool = filtering.with_rule(pool, list(rules), raw="example").where("rule_id IS NULL").drop("rule_id")
    recent = verdicts.where(F.col("created_at") >= F.lit(since).cast("timestamp")).select("program", "template")
    return pool.join(recent, ["program", "template"], "left_anti")


def sample(pool: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """``n`` shapes of the pool in random order, all of them if there are fewer; only with a ``seed`` the same again."""
    return pool.orderBy(F.rand() if seed is None else F.xxhash64(F.lit(seed), "program", "template")).limit(n)


#: Line numbers in a block of positions, and blocks in a block of blocks.
BLOCK = 4096


def placed(lines: DataFrame, *within: str, then: tuple[str, ...] = ()) -> DataFrame:
    """``lines`` with ``pos``: their place from 1 by ``line_no``, and by ``then``, among those of equal ``within``.

    Places are counted in blocks of line numbers, blocks in blocks of blocks, and added to the
    counts of those before, so the lines of a busy host are no single task's; what one task sums
    is a row for each 16 million line numbers.
    """
    tagged = lines.withColumn("_block", F.floor(F.col("line_no") / BLOCK))
    sizes = tagged.groupBy(*within, "_block").agg(F.count("*").alias("_n")).withColumn("_upper", F.floor(F.col("_block") / BLOCK))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda order, *keys: F.coalesce(F.sum("_n").over(earlier(*keys).orderBy(order)), F.lit(0))
    upper = sizes.groupBy(*within, "_upper").agg(F.sum("_n").alias("_n")).select(*within, "_upper", before("_upper", *within).alias("_first"))
    base = sizes.withColumn("_base", before("_block", *within, "_upper")).join(upper, [*within, "_upper"]).select(*within, "_block", (F.col("_base") + F.col("_first")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*within, "_block").orderBy("line_no", *then))
    return tagged.withColumn("_rank", rank).join(base, [*within, "_block"]).withColumn("pos", F.col("_base") + F.col("_rank")).drop("_block", "_base", "_rank")


def context(lines: DataFrame, anchors: DataFrame, radius: int = 5) -> DataFrame:
    """(anchor, line_no, raw): the lines of an anchor's host up to ``radius`` before and after it.

    ``lines``: (line_no, host, raw); ``anchors``: (anchor), line numbers.
    """
    own = placed(lines.select("line_no", "host", "raw"), "host")
    at = own.join(anchors, F.col("line_no") == F.col("anchor")).select("anchor", "host", F.explode(F.sequence(F.col("pos") - radius, F.col("pos") + radius)).alias("pos"))
    return at.join(own, ["host", "pos"]).select("anchor", "line_no", "raw")


def anchors(lines: DataFrame, examples: DataFrame) -> DataFrame:
    """(example_id, line_no, exact, shared): the line that each example is taken to come from.

    ``lines``: (line_no, host, program, raw); ``examples``: (example_id, host, program, raw).
    The first line that reads as the example, trimmed; else, of the lines of its host and
    program, the first of those that share most words with it, if any.
    """
    text = F.regexp_replace("raw", f"^{WS}+|(?![!-~]){WS}+$", "")
    wanted = bind(examples.select("example_id", "host", "program", "raw"), _text=text)
    first = bind(lines.select("line_no", "raw"), _text=text).join(wanted.select("_text").distinct(), "_text", "left_semi")
    first = first.groupBy("_text").agg(F.min("line_no").alias("line_no"))
    exact = wanted.join(first, "_text").select("example_id", "line_no", F.lit(True).alias("exact"), F.size(words("raw")).alias("shared"))
    near = fuzzy_anchor(lines, wanted.join(first, "_text", "left_anti")).select("example_id", "line_no", F.lit(False).alias("exact"), "shared")
    return exact.union(near)


def words(column: str):
    """The different words of a line."""
    return F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(f"{NS}+"), F.lit(0)))


def fuzzy_anchor(lines: DataFrame, examples: DataFrame) -> DataFrame:
    """(example_id, line_no, shared): the line of the same host and program that shares most words.

    ``lines``: (line_no, host, program, raw); ``examples``: (example_id, host, program, raw). The
    earliest of equals wins; examples that share no word with any line are left out. The
    examples of findings are few, so they go to the lines, which don't move beyond the join.
    """
    left = bind(examples.select("example_id", "host", "program", "raw"), a=words("raw")).drop("raw")
    right = bind(lines.select("line_no", "host", "program", "raw"), b=words("raw")).drop("raw")
    scored = bind(left.join(right, ["host", "program"]), shared=F.size(F.array_intersect("a", "b"))).where("shared > 0")
    best = scored.groupBy("example_id").agg(F.max(F.struct("shared", (-F.col("line_no")).alias("m"))).alias("b"))
    return best.select("example_id", (-F.col("b.m")).alias("line_no"), F.col("b.shared").alias("shared"))


def chunks(lines: DataFrame, size: int = 250) -> DataFrame:
    """``lines`` with ``chunk``: each but the last holds ``size`` lines, in the order of their numbers.

    Numbers may have gaps, as they have after filtering.
    """
    return placed(lines).withColumn("chunk", F.floor((F.col("pos") - 1) / size)).drop("pos")
