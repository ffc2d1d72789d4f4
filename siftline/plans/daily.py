"""A day's run from lines to stored findings, in one call."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions.lines import os_family, parse
from ..operators import detect, facts, filtering
from ..sources.store import Store


def day_anomalies(lines: DataFrame, counts: DataFrame, day: datetime.date, rules: list[filtering.Rule], inventory: DataFrame | None = None, hints=(("windows",), ("systemd",)), **limits) -> DataFrame:
    """(host, program, kind, bucket, score, direction, example, os): a day's strongest anomaly of each host and program.

    ``lines`` are the day's parsed ones, ``counts`` the stored counts up to that day; those that an
    active rule with a program covers are left out. ``limits``: ``peer``, ``baseline`` and
    ``temporal``, each the arguments of its detector.
    """
    today = counts.where(F.col("log_date") == F.lit(day))
    peer = detect.peer_anomalies(detect.pair_totals(today), **limits.get("peer", {}))
    base = detect.baseline_anomalies(detect.baseline_scores(counts, day), **limits.get("baseline", {}))
    times = detect.temporal_anomalies(detect.temporal_scores(counts, day), **limits.get("temporal", {}))
    found = filtering.mute(detect.combine(peer, base, times), filtering.active(rules, day))
    found = found.join(base.select("host", "program", "direction"), ["host", "program"], "left")
    families = detect.host_programs(today).select("host", os_family(F.col("programs"), *map(list, hints)).alias("os_family"))
    return facts.with_facts(found, detect.first_examples(lines), families, inventory)


def as_findings(anomalies: DataFrame, *more: str) -> DataFrame:
    """Anomalies as rows of ``Store.capture``, strongest first; ``pos`` rises with rank and has gaps, which its ids don't."""
    kind = F.col("kind")
    title = F.when(kind == "peer", B.PEER_HEADLINE).when(kind == "temporal", B.burst_headline(F.col("bucket"))).otherwise(B.baseline_headline(F.col("direction")))
    payload = F.to_json(F.struct("host", "program", "bucket", "score", "direction", "example", "os"))
    return detect.ranked(anomalies).select(
        *more, F.monotonically_increasing_id().alias("pos"), kind.alias("finding_kind"), F.lit("").alias("severity"), title.alias("title"),
        F.col("program").alias("service"), F.array("host").alias("hosts"), payload.alias("payload"),
    )


def run_day(
    store: Store, lines: DataFrame, day: datetime.date, *, rules: list[filtering.Rule] = (), table: list[tuple[str, str]] = (),
    inventory: DataFrame | None = None, keep: int = 90, **limits,
) -> DataFrame:
    """Stores a day's counts, run and findings; returns the lines (line_no, raw) that are worth reading.

    ``lines``: (line_no, raw) of that day. All of them are counted, those that rules drop too, and
    the day's counts and run replace older ones. Counts of days more than ``keep`` before go. The
    input is read once: what parsing makes of it is a table under the store's folder.
    """
    parsed = store.once(parse(lines))
    store.replace_day(detect.window_counts(parsed), day)
    store.prune(day, keep)
    known = filtering.active(list(rules), day)
    kept = store.once(filtering.log_filter(parsed.select("line_no", "raw"), known, list(table)))
    found = day_anomalies(parsed, store.counts(last=day), day, known, inventory, **limits)
    store.capture(as_findings(found), day, "daily", parsed.count(), kept.count())
    return filtering.collapse(kept)


def range_anomalies(counts: DataFrame, days: list[datetime.date], rules: list[filtering.Rule] = (), **limits) -> DataFrame:
    """(log_date, host, program, kind, bucket, score, direction): ``day_anomalies`` of many days in one plan, without facts.

    Every day is judged by the counts before it, as if the days had been run oldest first; rules are those in force on the day.
    """
    now = counts.where(F.col("log_date").isin(list(days)))
    peer = detect.peer_anomalies(detect.pair_totals(now, "log_date"), more=("log_date",), **limits.get("peer", {}))
    base = detect.baseline_anomalies(detect.range_baseline_scores(counts, days), **limits.get("baseline", {}))
    times = detect.temporal_anomalies(detect.range_temporal_scores(counts, days), **limits.get("temporal", {}))
    found = filtering.mute(detect.combine(peer, base, times, "log_date"), list(rules), F.col("log_date"))
    return found.join(base.select("log_date", "host", "program", "direction"), ["log_date", "host", "program"], "left")


def backfill(
    store: Store, lines: DataFrame, *, rules: list[filtering.Rule] = (), table: list[tuple[str, str]] = (), inventory: DataFrame | None = None,
    hints=(("windows",), ("systemd",)), **limits,
) -> DataFrame:
    """Counts, runs and findings of every day that ``lines`` (line_no, raw, log_date) holds, in one plan and one step; returns the findings.

    The same as ``run_day`` day by day, oldest first, with the counts that are stored of the days before. A
    day's lines are numbered in their order; days without lines have no run. No more days than a driver can list.
    """
    parsed = store.once(parse(lines.where("log_date IS NOT NULL")))
    raw_lines = {r.log_date: r["count"] for r in parsed.groupBy("log_date").count().collect()}
    days = sorted(raw_lines)
    if not days:
        return store.findings().limit(0)
    store.replace_days(detect.window_counts(parsed, "log_date"), days)
    counts = store.counts(days[0] - datetime.timedelta(days=14), days[-1])
    filtered = filtering.with_rule(parsed, list(rules), day=F.col("log_date")).where("rule_id IS NULL").drop("rule_id")
    kept = {r.log_date: r["count"] for r in filtering.cap_repeats(filtering.normalise(filtered, list(table)), within=("log_date",)).groupBy("log_date").count().collect()}
    found = range_anomalies(counts, days, rules, **limits)
    keys = ["log_date", "host", "program"]
    first = parsed.where("program IS NOT NULL").groupBy(*keys).agg(F.min_by("raw", "line_no").alias("example"))
    families = counts.where(F.col("log_date").isin(days)).groupBy("log_date", "host").agg(F.array_sort(F.collect_set("program")).alias("programs"))
    families = families.select("log_date", "host", os_family(F.col("programs"), *map(list, hints)).alias("os_family"))
    told = facts.with_facts(found, first, families, inventory, "log_date")
    store.capture_days(as_findings(told, "log_date"), {day: (raw_lines[day], kept.get(day, 0)) for day in days}, "daily")
    return store.findings(days[0], days[-1], "daily")
