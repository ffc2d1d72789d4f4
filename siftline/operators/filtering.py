"""Known-line rules, normalising, the cap on repeats, spread and collapsing."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import bind, field, glob_regex, java_regex, parse, program_of, templates, untag, with_key
from . import rulesets

#: Rules tested in one expression; longer lists are cut so that generated code stays small. Rules above
#: which lines are looked up in an index of rules first.
CHUNK, MANY = 25, 200
CAP = 3


@dataclass(frozen=True)
class Rule:
    """A known entry: a host glob, and a regex on the text after the host or else a program glob."""

    id: int
    host: str = "*"
    program: str = ""
    match: str = ""
    expires: datetime.date | None = None

    def active(self, day: datetime.date) -> bool:
        return self.expires is None or day <= self.expires


def active(rules: list[Rule], day: datetime.date) -> list[Rule]:
    """Rules in force on the slice's day, in the order of their ids."""
    return sorted((r for r in rules if r.active(day)), key=lambda r: r.id)


def rule_of(rules: list[Rule], host: Column, program: Column, rest: Column, day: Column | None = None) -> Column:
    """The id of the first rule that fits a line, null if none does; with ``day``, of those in force on it."""

    def one(rule: Rule) -> Column:
        fits = F.lit(True) if rule.host == "*" else host.rlike(glob_regex(rule.host))
        if rule.host == "*":
            fits = ~host.contains("/")
        if day is not None and rule.expires is not None:
            fits = fits & (day <= F.lit(rule.expires))
        if rule.match:
            return F.when(fits & rest.rlike("(?md)" + java_regex(rule.match)), F.lit(rule.id))
        return F.when(fits & (program != "") & program.rlike(glob_regex(rule.program)), F.lit(rule.id))

    parts = [F.coalesce(*map(one, rules[k : k + CHUNK])) for k in range(0, len(rules), CHUNK)]
    return F.coalesce(*parts).cast("long") if parts else F.lit(None).cast("long")


def with_rule(lines: DataFrame, rules: list[Rule], raw: str = "raw", day: Column | None = None) -> DataFrame:
    """``lines`` with ``rule_id``; lines of fewer than five fields fit no rule. With ``day``, of the rules in force on it."""
    if len(rules) > MANY:
        return rulesets.with_rule(lines, rules, raw, day)
    lines = bind(lines, _host=field(F.col(raw), 4), _rest=F.nullif(field(F.col(raw), 5), F.lit("")))
    lines = bind(lines, _program=program_of(F.col("_rest")))
    fits = F.when(F.col("_rest").isNotNull(), rule_of(rules, F.col("_host"), F.col("_program"), F.col("_rest"), day))
    return bind(lines, rule_id=fits).drop("_host", "_rest", "_program")


def known_hits(tagged: DataFrame) -> DataFrame:
    """(rule_id, lines, hosts) of the rules that dropped lines of ``with_rule``."""
    host = field(F.col("raw"), 4)
    return tagged.where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("lines"), F.count_distinct(host).alias("hosts"))


def hit_messages(tagged: DataFrame, rule_id: int) -> DataFrame:
    """(message, lines) of one rule's hits, pids stripped."""
    return with_key(tagged.where(F.col("rule_id") == rule_id)).groupBy(F.col("_key").alias("message")).agg(F.count("*").alias("lines"))


def muted(anomalies: DataFrame, rules: list[Rule], day: Column | None = None) -> DataFrame:
    """Anomalies with ``rule_id``, the first rule with a program glob that covers them; with ``day``, of those in force on it."""
    with_program = [Rule(r.id, r.host, r.program, expires=r.expires) for r in rules if r.program]
    return anomalies.withColumn("rule_id", rule_of(with_program, F.col("host"), F.col("program"), F.lit(""), day))


def mute(anomalies: DataFrame, rules: list[Rule], day: Column | None = None) -> DataFrame:
    """Anomalies that no rule with a program glob covers."""
    return muted(anomalies, rules, day).where("rule_id IS NULL").drop("rule_id")


def with_muted(hits: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``known_hits`` to which the anomalies of ``muted`` are added: each counts once and its host with the lines' hosts.

    ``hits``: (rule_id, host, lines), a row for each rule and host, as ``host_hits`` gives.
    """
    more = anomalies.where("rule_id IS NOT NULL").select("rule_id", "host", F.lit(0).cast("long").alias("lines"), F.lit(1).cast("long").alias("anomalies"))
    every = hits.withColumn("anomalies", F.lit(0).cast("long")).unionByName(more)
    return every.groupBy("rule_id").agg(F.sum("lines").alias("lines"), F.sum("anomalies").alias("anomalies"), F.count_distinct("host").alias("hosts"))


def host_hits(tagged: DataFrame) -> DataFrame:
    """(rule_id, host, lines) of the lines that rules dropped."""
    return tagged.where("rule_id IS NOT NULL").groupBy("rule_id", field(F.col("raw"), 4).alias("host")).agg(F.count("*").alias("lines"))


def normalise(lines: DataFrame, table: list[tuple[str, str]], raw: str = "raw") -> DataFrame:
    """Lines of the first pattern that matches them become their first four fields and its text."""
    if not table:
        return lines
    if len(table) > MANY:
        lines = rulesets.said_of(lines, table, raw)
    else:
        parts = [F.coalesce(*[F.when(F.col(raw).rlike("(?md)" + java_regex(p)), F.lit(text)) for p, text in table[k : k + CHUNK]]) for k in range(0, len(table), CHUNK)]
        lines = bind(lines, _said=F.coalesce(*parts))
    said = F.col("_said")
    head = [field(F.col(raw), k) for k in (1, 2, 3, 4)]
    made = F.when(head[0] != "", F.concat_ws(" ", *head, said)).otherwise(said)
    return bind(lines, **{raw: F.when(said.isNotNull(), made).otherwise(F.col(raw))}).drop("_said")


def spread(lines: DataFrame) -> DataFrame:
    """(key, hosts): how many hosts logged each message, over all lines."""
    return with_key(lines).groupBy(F.col("_key").alias("key")).agg(F.count_distinct("_host").alias("hosts"))


def cap_repeats(lines: DataFrame, most: int = CAP, within: tuple[str, ...] = ()) -> DataFrame:
    """The first ``most`` lines of each message (and of each of ``within``, days say) in input order, whichever hosts they are of."""
    order = Window.partitionBy("_key", *within).orderBy("line_no")
    return with_key(lines).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_key", "_host", "_n")


def log_filter(lines: DataFrame, rules: list[Rule], table: list[tuple[str, str]]) -> DataFrame:
    """Known lines out, the rest normalised and capped."""
    return cap_repeats(normalise(with_rule(lines, rules).where("rule_id IS NULL").drop("rule_id"), table))


def collapse(lines: DataFrame, once: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(line_no, raw): repeats of host, program and template in their first line, tagged with number and times.

    ``once`` (a store's) keeps the lines' templates, which are used twice.
    """
    shaped = once(templates(parse(lines)).select("line_no", "raw", "stamp", "host", "program", "template"))
    fit = shaped.where("template IS NOT NULL")
    groups = fit.groupBy("host", "program", "template").agg(
        F.count("*").alias("n"), F.min(F.struct("line_no", "raw", "stamp")).alias("a"), F.max(F.struct("line_no", "stamp")).alias("z")
    )
    tag = F.concat(F.lit("[x"), F.col("n").cast("string"), F.lit(" "), F.col("a.stamp"), F.lit("-"), F.col("z.stamp"), F.lit("] "), F.col("a.raw"))
    folded = groups.select("a.line_no", F.when(F.col("n") > 1, tag).otherwise(F.col("a.raw")).alias("raw"))
    return folded.union(shaped.where("template IS NULL").select("line_no", "raw"))


def tag_spread(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Lines of messages that several hosts logged, with a tag that says how many."""
    joined = with_key(lines, untag(F.col("raw"))).join(counts.select(F.col("key").alias("_key"), "hosts"), "_key", "left")
    tag = F.concat(F.lit("[on "), F.col("hosts").cast("string"), F.lit(" hosts] "), F.col("raw"))
    return joined.withColumn("raw", F.when(F.col("hosts") > 1, tag).otherwise(F.col("raw"))).drop("_key", "_host", "hosts")
