"""Requests to a model as rows: ordered lines, issues and anomalies packed into texts of bounded size.

A place in the order is a rank in blocks (``shapes.placed``), a payload a run of places, and its text an
aggregate of as many rows as a payload may hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import BLOCK, placed

#: Lines, issues and anomalies in one payload (fixed values).
LINES, ISSUES, ANOMALIES = 250, 12, 15


def packed(rows: DataFrame, size: int, text: str, *within: str, separator: str = "\n") -> DataFrame:
    """(within, payload, n, first, text): the ``text`` of up to ``size`` rows each, in the order of ``line_no``; payloads count from 0."""
    at = placed(rows.select(*within, "line_no", F.col(text).alias("_text")), *within).withColumn("payload", F.floor((F.col("pos") - 1) / size))
    held = at.groupBy(*within, "payload").agg(F.count("*").alias("n"), F.min("line_no").alias("first"), F.array_sort(F.collect_list(F.struct("pos", "_text"))).alias("t"))
    return held.select(*within, "payload", "n", "first", F.array_join(F.transform("t", lambda t: t["_text"]), separator).alias("text"))


def within_budget(rows: DataFrame, budget: int, text: str, tokens: Column, *within: str, separator: str = "\n") -> DataFrame:
    """``packed`` by tokens: a payload holds the rows that begin in one stretch of ``budget`` tokens and end in it.

    A row that crosses the end of a stretch is a payload of its own, so none holds more than the
    budget but a single row that does by itself. Prefix sums are made in blocks and over their sums.
    """
    each = rows.select(*within, "line_no", F.col(text).alias("_text"), F.greatest(tokens.cast("long"), F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("line_no") / BLOCK))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy(*within, "_block").agg(F.sum("_n").alias("_all")).withColumn("_upper", F.floor(F.col("_block") / BLOCK))
    uppers = sums.groupBy(*within, "_upper").agg(F.sum("_all").alias("_all"))
    uppers = uppers.select(*within, "_upper", F.coalesce(F.sum("_all").over(before.partitionBy(*within).orderBy("_upper")), F.lit(0)).alias("_first"))
    inner = F.coalesce(F.sum("_all").over(before.partitionBy(*within, "_upper").orderBy("_block")), F.lit(0))
    base = sums.withColumn("_inner", inner).join(uppers, [*within, "_upper"]).select(*within, "_block", (F.col("_first") + F.col("_inner")).alias("_base"))
    own = F.coalesce(F.sum("_n").over(before.partitionBy(*within, "_block").orderBy("line_no")), F.lit(0))
    at = each.withColumn("_own", own).join(base, [*within, "_block"]).withColumn("_start", F.col("_base") + F.col("_own"))
    low, high = F.floor(F.col("_start") / budget), F.floor((F.col("_start") + F.col("_n") - 1) / budget)
    at = at.withColumn("_span", 2 * low + (low != high).cast("long"))
    held = at.groupBy(*within, "_span").agg(
        F.count("*").alias("n"), F.sum("_n").alias("tokens"), F.min("line_no").alias("first"), F.array_sort(F.collect_list(F.struct("line_no", "_text"))).alias("t")
    )
    return held.select(*within, F.col("_span").alias("payload"), "n", "tokens", "first", F.array_join(F.transform("t", lambda t: t["_text"]), separator).alias("text"))


def quoted(text: Column) -> Column:
    """A field of a payload in quotes: single ones, double ones if it holds single but no double quotes; backslashes, that quote and line ends escaped."""
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(char), F.lit(shown))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def anomaly_lines(anomalies: DataFrame) -> DataFrame:
    """``anomalies`` (line_no, host, program, os_family, headline, summary, example) with ``line``, their line of a payload, numbered from 1 in the batch of ANOMALIES."""
    at = placed(anomalies)
    field = lambda name, value: F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit("")))
    number = F.concat(((F.col("pos") - 1) % ANOMALIES + 1).cast("string"), F.lit("."))
    said = [field(n, F.col(n)) for n in ("host", "program", "os_family")] + [field(n, quoted(F.coalesce(c, F.lit("")))) for n, c in (("what", "headline"), ("detail", "summary"), ("example", "example"))]
    return at.withColumn("line", F.concat_ws(" ", number, *said)).drop("pos")


def issue_json(issues: DataFrame, names: list[str]) -> DataFrame:
    """``issues`` (line_no, ...) with ``json``: the columns ``names`` as an object indented by two blanks within a list."""
    value = {f.name: F.to_json(F.struct(f.name), {"ignoreNullFields": "false"}) for f in issues.schema.fields if f.name in names}
    # the object of one column without its braces
    parts = [F.concat(F.lit(f'    "{n}": '), F.expr(f"substring({n}_json, {len(n) + 5}, length({n}_json) - {len(n) + 5})")) for n in names]
    held = issues.withColumns({f"{n}_json": value[n] for n in names})
    return held.withColumn("json", F.concat(F.lit("  {\n"), F.array_join(F.array(*parts), ",\n"), F.lit("\n  }"))).drop(*[f"{n}_json" for n in names])


def context_block(host: Column, lines: Column) -> Column:
    """The lines around an issue's example as a block of a payload; empty without lines (fixed text)."""
    head = F.concat(F.lit("**Surrounding log lines** (host "), host, F.lit(", immediately before and after the example, may include unrelated activity):\n\n```\n"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(head, F.array_join(lines, "\n"), F.lit("\n```\n"))).otherwise("")
