"""Known entries: read from rule files, made from findings and shapes, kept without duplicates."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Program names and literal hosts that an entry may hold (fixed values).
PROGRAM_TOKEN = r"^[A-Za-z0-9._/-]+\z"
HOST_TOKEN = r"^[A-Za-z0-9][A-Za-z0-9._:-]*\z"
#: What each token of a template may stand for in a line (fixed values).
TOKENS = {
    "<n>": r"\d+", "<ip>": r"\d{1,3}(?:\.\d{1,3}){3}", "<ip6>": r"\S+", "<host>": r"\S+", "<fqdn>": r"\S+", "<hex>": r"\S+",
    "<user>": r"\S+", "<email>": r"\S+",
}
UNITS = {"h": "hours", "d": "days", "w": "weeks"}


def read_rules(text: str, reason: str = "", check: Callable[[str], object] = re.compile) -> list[dict]:
    """Rules of a file: line, host glob, pattern and reason; a ValueError names the line that is wrong.

    A line is ``[host=GLOB ]PATTERN[ # REASON]``; empty lines and those that begin with ``#`` are
    left out. A ``#`` that follows no blank belongs to the pattern. ``check`` raises on a bad pattern.
    """
    rules = []
    for line, written in enumerate(text.splitlines(), 1):
        if not written.strip() or written.strip().startswith("#"):
            continue
        body, *said = re.split(r"(?<=[ \t])#", written.strip(), maxsplit=1)
        own = re.fullmatch(r"(?:host=(?P<host>[^ ]+) +)?(?P<match>.+)", body.strip())
        if own["match"].startswith("host="):
            raise ValueError(f"line {line}: a host glob needs a pattern after it")
        try:
            check(own["match"].strip())
        except Exception as wrong:
            raise ValueError(f"line {line}: {wrong}") from wrong
        rules.append({"line": line, "host": own["host"] or "*", "match": own["match"].strip(), "reason": said[0].strip() if said else reason})
    return rules


def seeds(rules: DataFrame, existing: DataFrame) -> DataFrame:
    """Rules (line, host, match, ...) that no existing entry has by host and match; the first line of repeats."""
    new = rules.join(existing.select("host", "match"), ["host", "match"], "left_anti")
    return new.groupBy("host", "match").agg(F.min_by(F.struct(*rules.columns), "line").alias("r")).select("r.*")


def from_findings(findings: DataFrame, hosts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(finding_id, host, program): the entries that would mute each finding.

    ``findings``: (id, program, service), the program of an anomaly or of an issue's example, null
    if it has none; then a service that is a name stands in. ``wanted``: (finding_id, host) mutes
    these hosts only. A finding is refused as a whole, and has no rows, if its program or one of
    its hosts is no literal name, if it has no host, or if it lacks a host that is wanted.
    """
    program = F.coalesce("program", F.when(F.col("service").rlike(PROGRAM_TOKEN), F.col("service")))
    named = findings.select(F.col("id").alias("finding_id"), program.alias("program")).where(F.col("program").rlike(PROGRAM_TOKEN))
    each = hosts.select("finding_id", "host").where("host != ''").distinct()
    if wanted is not None:
        asked = wanted.select("finding_id", "host").distinct()
        lacking = asked.join(each, ["finding_id", "host"], "left_anti").select("finding_id").distinct()
        some = asked.select("finding_id").distinct().withColumn("some", F.lit(True))
        kept = asked.withColumn("mine", F.lit(True))
        each = each.join(lacking, "finding_id", "left_anti").join(some, "finding_id", "left").join(kept, ["finding_id", "host"], "left")
        each = each.where("some IS NULL OR mine").select("finding_id", "host")
    odd = each.where(~F.col("host").rlike(HOST_TOKEN)).select("finding_id").distinct()
    return named.join(each.join(odd, "finding_id", "left_anti"), "finding_id").select("finding_id", "host", "program")


def active(entries: DataFrame, day: datetime.date) -> DataFrame:
    """Entries in force on a day: those without an end, and those whose last day it is or that end later."""
    return entries.where(F.col("expires").isNull() | (F.col("expires") >= F.lit(day)))


def chosen(entries: DataFrame, *, day: datetime.date | None = None, host: str = "", finding_id: int | None = None) -> DataFrame:
    """Entries in force on ``day``, for exactly that host glob, made for that finding; each only if it is given."""
    out = entries if day is None else active(entries, day)
    out = out.where(F.col("host") == host) if host else out
    return out if finding_id is None else out.where(F.col("finding_id") == finding_id)


def fresh(entries: DataFrame, existing: DataFrame, day: datetime.date) -> DataFrame:
    """Entries (finding_id, host, program, match) that no active one repeats for its finding."""
    keys = ["finding_id", "host", "program", "match"]
    return entries.join(active(existing, day).select(*keys), keys, "left_anti")


def added(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with ``new`` ones after them; none is added if one of them has neither program nor pattern."""
    bad = new.where((F.coalesce("program", F.lit("")) == "") & (F.coalesce("match", F.lit("")) == ""))
    if not bad.isEmpty():
        raise ValueError("an entry needs a program or a pattern")
    return entries.unionByName(new)


def removed(entries: DataFrame, entry_id: int) -> tuple[DataFrame, bool]:
    """Entries without one of them, and whether it was there."""
    return entries.where(F.col("id") != entry_id), not entries.where(F.col("id") == entry_id).isEmpty()


def since(text: str, now: datetime.datetime) -> datetime.datetime:
    """The time that ``1h``, ``3d`` or ``2w`` before ``now`` is, or the start of a day ``YYYY-MM-DD``."""
    span = re.fullmatch(r"([0-9]+)([hdw])", text)
    return now - datetime.timedelta(**{UNITS[span[2]]: int(span[1])}) if span else datetime.datetime.fromisoformat(text)


def overview(entries: DataFrame, first: datetime.datetime | None = None, source: str = "", bundled: bool = False) -> DataFrame:
    """Entries (id, source, created_at, ...), newest first; bundled ones only if asked for by source or by flag."""
    out = entries.where(F.col("created_at") >= F.lit(first)) if first else entries
    if source:
        out = out.where(F.col("source") == source)
    elif not bundled:
        out = out.where("source != 'bundled'")
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def template_regex(program: Column, template: Column) -> Column:
    """The pattern of a shape's lines after the host: program, pid and colon if any, tokens widened."""
    quoted = lambda text: F.regexp_replace(text, r"[\\.+*?()|\[\]{}^$]", r"\\$0")
    rest = quoted(template)
    for token, pattern in TOKENS.items():
        rest = F.replace(rest, F.lit(token), F.lit(pattern))
    return F.concat(quoted(program), F.lit(r"(?:\[\d+\])?:? "), rest)


def shape_matches(shapes: DataFrame) -> DataFrame:
    """Shapes (program, template, example) with ``match``, and whether it ``fits`` their own example.

    A pattern that does not is a fault of the template and must not be stored.
    """
    made = shapes.withColumn("match", template_regex(F.col("program"), F.col("template")))
    return made.withColumn("fits", F.regexp_like("example", F.col("match")))


def reviewed(shapes: DataFrame, ticked: DataFrame) -> DataFrame:
    """Shapes that were shown with ``verdict``: muted if ticked and fit, kept if not ticked, else problem."""
    keys = ["program", "template"]
    marked = shape_matches(shapes).join(ticked.select(*keys).distinct().withColumn("_t", F.lit(True)), keys, "left")
    return marked.withColumn("verdict", F.when(F.col("_t").isNull(), "kept").when(F.col("fits"), "muted").otherwise("problem")).drop("_t")


def replaced_pool(stored: DataFrame, shapes: DataFrame, day: datetime.date) -> tuple[DataFrame, bool]:
    """The pool of ``day``'s shapes and True, or ``stored`` and False if that is of a later day."""
    newest = stored.agg(F.max("day")).first()[0]
    if newest is not None and newest > day:
        return stored, False
    return shapes.withColumn("day", F.lit(day)), True
