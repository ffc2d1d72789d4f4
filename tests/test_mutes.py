"""Rule files, entries made from findings and shapes, and the words of reports, on small cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from siftline.functions import labels
from siftline.operators import facts, library, mutes

DAY = datetime.date(2024, 5, 2)


def test_rule_file():
    text = "# a comment\n\nkernel: eth[0-9]+ up # links\n  host=web* nginx.* 200\nnamed: a#53\nhost=db1  slow query\t# known"
    got = [(r["line"], r["host"], r["match"], r["reason"]) for r in mutes.read_rules(text, reason="routine")]
    assert got == [(3, "*", "kernel: eth[0-9]+ up", "links"), (4, "web*", "nginx.* 200", "routine"), (5, "*", "named: a#53", "routine"), (6, "db1", "slow query", "known")]
    for bad in ("ok\nhost=web", "ok\nhost= x", "ok\nan (open group", "ok\nhost=web # no pattern"):
        with pytest.raises(ValueError, match="line 2"):
            mutes.read_rules(bad)


def test_since():
    now = datetime.datetime(2024, 5, 20, 12)
    assert [mutes.since(s, now) for s in ("5h", "3d", "2w", "2024-01-02")] == [
        now - datetime.timedelta(hours=5), now - datetime.timedelta(days=3), now - datetime.timedelta(days=14), datetime.datetime(2024, 1, 2)
    ]
    with pytest.raises(ValueError):
        mutes.since("soon", now)


def test_entries_of_findings(spark):
    findings = spark.createDataFrame(
        [(1, "cron", "x y"), (2, None, "nginx"), (3, None, "no name"), (4, "sshd", ""), (5, "sshd", ""), (6, "a*", ""), (7, "cron", "")], "id long, program string, service string"
    )
    hosts = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (1, ""), (2, "c"), (3, "a"), (4, "web*"), (4, "a"), (6, "a"), (7, "a"), (7, "d")], "finding_id long, host string")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(mutes.from_findings(findings, hosts)) == [(1, "a", "cron"), (1, "b", "cron"), (2, "c", "nginx"), (7, "a", "cron"), (7, "d", "cron")]
    wanted = spark.createDataFrame([(1, "b"), (4, "a"), (7, "a"), (7, "elsewhere")], "finding_id long, host string")
    # 4's odd host is not wanted, so the rest of it can be muted; 7 lacks a host that is wanted
    assert got(mutes.from_findings(findings, hosts, wanted)) == [(1, "b", "cron"), (2, "c", "nginx"), (4, "a", "sshd")]
    assert got(mutes.from_findings(findings.limit(0), hosts)) == []


def test_kept_entries(spark):
    old = spark.createDataFrame([(1, "a", "p", "", DAY), (1, "b", "p", "", None), (2, "a", "p", "x", DAY)], "finding_id long, host string, program string, match string, expires date")
    new = old.drop("expires")
    hosts = lambda day: sorted((r.finding_id, r.host) for r in mutes.fresh(new, old, day).collect())
    assert hosts(DAY) == [] and hosts(DAY + datetime.timedelta(days=1)) == [(1, "a"), (2, "a")]
    assert mutes.added(new, new).count() == 6
    with pytest.raises(ValueError):
        mutes.added(new, spark.createDataFrame([(3, "a", None, "")], new.schema))
    rest, gone = mutes.removed(spark.range(3), 1)
    assert rest.count() == 2 and gone and not mutes.removed(spark.range(3), 9)[1]


def test_shapes(spark):
    rows = [("a.b", "took <n> ms (<ip>) {x}", "h a.b[12]: took 7 ms (10.0.0.1) {x}"), ("p", "from <host>", "p nothing alike")]
    shapes = spark.createDataFrame(rows, "program string, template string, example string")
    got = {r.program: r for r in mutes.shape_matches(shapes).collect()}
    assert got["a.b"].match == r"a\.b(?:\[\d+\])?:? took \d+ ms \(\d{1,3}(?:\.\d{1,3}){3}\) \{x\}"
    assert got["a.b"].fits and not got["p"].fits
    verdicts = lambda ticked: [r.verdict for r in mutes.reviewed(shapes, ticked).orderBy("program").collect()]
    assert verdicts(shapes) == ["muted", "problem"] and verdicts(shapes.limit(0)) == ["kept", "kept"]
    pool, taken = mutes.replaced_pool(shapes.limit(1).withColumn("day", F.lit(DAY)), shapes, DAY - datetime.timedelta(days=1))
    assert pool.count() == 1 and not taken
    for stored in (pool, pool.limit(0)):
        later, taken = mutes.replaced_pool(stored, shapes, DAY)
        assert later.count() == 2 and taken


def test_titles_and_resolutions(spark):
    groups = spark.createDataFrame(
        [("disk", "a", 3, 0, "s", 1), ("disk", "a,b", 2, 0, "s", 2), ("disk", "", 1, 0, "s", 3), ("net", "a", 1, 0, "s", 4)], "title string, hosts string, n_days long, rank int, service string, latest_id long"
    )
    assert [r.unique_title for r in facts.unique_titles(groups).orderBy("latest_id").collect()] == ["disk (a)", "disk (a) #2", "disk", "net"]
    said = spark.createDataFrame([(0, "disk", "old"), (2, "disk", "new"), (1, "Net", "no")], "pos long, title string, resolution string")
    got = facts.resolved(groups, said).orderBy("latest_id").collect()
    assert [r.resolution for r in got] == ["new", "new", "new", None]
    users = spark.createDataFrame([(5, "ann")], "id long, name string")
    votes = spark.createDataFrame([(1, 5, DAY), (1, None, DAY), (2, 9, DAY)], "finding_id long, user_id long, created_at date")
    assert sorted((r.finding_id, r.name) for r in library.feedback(votes, users).collect()) == [(1, ""), (1, "ann"), (2, "")]


def test_facts_that_are_missing(spark):
    odd = spark.createDataFrame([("a", "p"), ("b", "q")], "host string, program string")
    none = lambda more: spark.createDataFrame([], more)
    out = facts.with_facts(odd, none("host string, program string, example string"), none("host string, os_family string"), spark.createDataFrame([("b", "bsd")], "host string, os string"))
    out = facts.explained(out, none("host string, program string, explanation string"))
    assert [tuple(r) for r in out.select("host", "os", "example", "explanation").orderBy("host").collect()] == [("a", "unknown", "", None), ("b", "bsd", "", None)]
    upper = spark.createDataFrame([("B",), ("a",), ("b",)], "host string")
    assert [r.host for r in facts.inventory_order(upper).collect()] == ["a", "B", "b"]


def test_words(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (4.0, 0.0), (2.0, 9.0), (300.0, 3.0), (1.0, 10.0)], "a double, b double")
    assert [r.x for r in rows.select(labels.change(F.col("a"), F.col("b")).alias("x")).collect()] == ["new", "stopped", "up 4.5x", "down 100x", "up 10x"]
    scores = spark.createDataFrame([(0.0,), (0.004,), (0.005,), (1.0,)], "s double")
    assert [r.x for r in scores.select(labels.percent(F.col("s")).alias("x")).collect()] == ["0%", "under 1%", "1%", "100%"]
    bars = spark.createDataFrame([(0, 900), (1, 900), (899, 900), (900, 900)], "n long, m long")
    assert [r.x for r in bars.select(labels.bar(F.col("n"), F.col("m")).alias("x")).collect()] == [0, 1, 99, 100]
    days = spark.createDataFrame([([DAY, DAY - datetime.timedelta(days=1)],)], "d array<date>")
    assert days.select(labels.recurrence(F.col("d"), F.lit(7)).alias("x")).first().x == "Seen on 2 of 7 run days: Wed 1 May, Thu 2 May"
    assert [r.x for r in spark.createDataFrame([(3.0,), (2.5,)], "m double").select(labels.half(F.col("m")).alias("x")).collect()] == ["3", "2.5"]
