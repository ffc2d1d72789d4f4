"""Digest and report in one call, filters, labels, files."""

from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.operators import library, mutes, shapes
from siftline.operators.filtering import Rule
from siftline.plans import reports
from siftline.sources.store import Store

FIRST = datetime.date(2026, 8, 25)
SCHEMA = "log_date date, pos int, finding_kind string, severity string, title string, service string, hosts array<string>, payload string"


@pytest.fixture
def store(spark, tmp_path):
    """Five days of which one has no run and one spent its budget."""
    store = Store(spark, f"file://{tmp_path}/store")
    days = [FIRST + datetime.timedelta(days=k) for k in (0, 1, 3, 4)]
    rows = []
    for k, day in enumerate(days):
        rows.append((day, 0, "issue", "low", "Disk fills", "kernel", ["a", "b"], "{}"))
        rows.append((day, 1, "peer", "", "Louder", "cron", ["h"], "{}"))
        if k == 2:
            rows += [(day, 2, "issue", "critical", "Disk fills", "raid", ["c"], "{}"), (day, 3, "temporal", "", "Burst", "cron", ["h"], "{}"), (day, 4, "issue", "low", "Once", "x", ["d"], "{}")]
    store.capture_days(store.spark.createDataFrame(rows, SCHEMA), {d: (1000, 10) for d in days[:3]} | {days[3]: (None, None)}, "daily")
    store.flag_budget(days[1])
    counts = [(f"h{k}", "p", "10:00", 10 * (k + 1), d) for k in range(3) for d in days]
    store.replace_days(spark.createDataFrame(counts, store.COUNTS), days)
    return store


def test_digest(store):
    last = FIRST + datetime.timedelta(days=4)
    for _ in range(2):
        made = reports.write_digest(store, FIRST, last)
    found = [(r.finding_kind, r.title, r.severity, r.hosts, json.loads(r.payload)["n_days"]) for r in made.findings.orderBy("id").collect()]
    assert found == [("issue", "Disk fills (a)", "low", ["a", "b"], 4), ("issue", "Disk fills (c)", "critical", ["c"], 1), ("peer", "cron on h", "", ["h"], 4)]
    assert store.findings(kind="digest").count() == 3 and store.runs(kind="digest").first().raw_lines is None
    assert made.notices()[0].startswith("**Token budget reached on Wed 26 Aug.**") and made.notices()[1] == "Covers 4 daily runs. No run was recorded for Thu 27 Aug."
    text = reports.digest_text(made, "Week")
    assert text.startswith("# Week\n\n**Token") and "low, 4 of 4 days, a, b" in text
    path = reports.write_file(store, "digest_body.md", "old")
    assert reports.write_file(store, "digest_body.md", text) == path and open(path.removeprefix("file://")).read() == text
    none = reports.write_digest(store, FIRST - datetime.timedelta(days=9), FIRST - datetime.timedelta(days=8))
    assert none.findings.count() == 0 and none.notices() == ["Covers 0 daily runs. No run was recorded for Sun 16 Aug, Mon 17 Aug."]


def test_management(store):
    last = FIRST + datetime.timedelta(days=4)
    tables = reports.management(store, FIRST, last)
    total = tables["totals"].first()
    assert (total.days_with_data, total.approximate_days, total.volume, total.filtered, total.have_filtered, total.n_findings) == (4, 1, 3060, 30, True, 11)
    assert {r.label: r.n for r in tables["severities"].collect()} == {"low": 5, "critical": 1, "anomaly": 5}
    text = reports.management_text(tables, FIRST, last)
    assert text.startswith("# 25 Aug to 29 Aug 2026\n") and "## days" in text and "## movers" not in text


def test_filters(spark, store):
    reports.write_digest(store, FIRST, FIRST + datetime.timedelta(days=4))
    found, hosts, runs = store.findings(), store.hosts(), store.runs()
    assert library.search(found.drop("kind"), hosts, runs=runs, run_kind="digest").count() == 3 and library.search(found, hosts, runs=runs, run_kind="daily", host="C").count() == 1
    with pytest.raises(ValueError):
        library.search(found, hosts, run_kind="hourly")
    entries = spark.createDataFrame([(1, "h*", 5, None), (2, "h*", 6, FIRST), (3, "g", 5, FIRST)], "id long, host string, finding_id long, expires date")
    ids = lambda **k: sorted(r.id for r in mutes.chosen(entries, **k).collect())
    assert ids() == [1, 2, 3] and ids(host="h*") == [1, 2] and ids(finding_id=5) == [1, 3] and ids(day=FIRST + datetime.timedelta(days=1)) == [1] and ids(host="g", finding_id=6) == []
    pool = spark.createDataFrame([("p", "t", "Jan  1 10:00:00 h1 p: t"), ("q", "t", "Jan  1 10:00:00 h1 q: t")], "program string, template string, example string")
    seen = spark.createDataFrame([], "program string, template string, created_at timestamp")
    assert [r.program for r in shapes.unreviewed(pool, seen, "2024-01-01", [Rule(1, "h*", "p")]).collect()] == ["q"] and shapes.unreviewed(pool, seen, "2024-01-01").count() == 2


def test_compact(spark):
    values = [0.0, 1.0, -2.5, 1234567.0, 123456.0, 0.0001, 0.00001234567, 1e-300, 99999.95, 999999.5, 0.1 + 0.2, 100000.0, -1e6, 1e100]
    got = [r.c for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", labels.compact(F.col("x")).alias("c")).collect()]
    assert got == ["%.6g" % v for v in values]


def test_hosts_summary(spark):
    from siftline.functions.lines import hosts_summary

    rows = spark.createDataFrame([([f"h{k}" for k in range(n)],) for n in (0, 1, 5, 8)], "h array<string>").select(hosts_summary(F.col("h")).alias("s"))
    assert [r.s for r in rows.collect()] == ["", "h0", "h0, h1, h2, h3, h4", "h0, h1, h2, h3, h4 and 3 more"]

