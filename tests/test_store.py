"""The versioned store: captures that stop, upserts, point reads, work that is done once."""

from __future__ import annotations

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from siftline.sources.store import Store
from siftline.sources.versions import Conflict, Once

DAY = datetime.date(2024, 3, 5)
SCHEMA = "pos int, finding_kind string, severity string, title string, service string, hosts array<string>, payload string"
VOTE = "finding_id long, user_id long, verdict string, comment string, created_at timestamp"


def made(spark, n, tag="t", hosts=("h", "g", "h")):
    return spark.createDataFrame([(k * 7, "issue", "high", f"{tag}{k}", "s", list(hosts), f'{{"host": "h{k}", "score": {k}.5}}') for k in range(n)], SCHEMA)


def vote(spark, *rows):
    return spark.createDataFrame([(f, u, v, c, datetime.datetime(2024, 3, 6, h)) for f, u, v, c, h in rows], VOTE)


def state(store):
    return (
        sorted((r.id, r.run_id, str(r.log_date), r.kind, r.title) for r in store.findings().collect()),
        sorted((r.run_id, str(r.log_date), r.kind, r.raw_lines, r.filtered_lines) for r in store.runs().collect()),
        sorted((r.finding_id, r.pos, r.host) for r in store.hosts().collect()),
        sorted((r.finding_id, r.user_id or -1, r.verdict, r.comment) for r in store.votes().collect()),
    )


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=8)


def test_a_capture_replaces_its_run_and_votes(spark, store):
    first = store.capture(made(spark, 3), DAY, "daily", 100, -1)
    assert [r.id for r in first.orderBy("pos").collect()] == [1, 2, 3]
    store.capture(made(spark, 2, "d"), DAY, "digest")
    store.vote(vote(spark, (1, 7, "worked", "", 1), (3, None, "didnt_work", "no", 1), (4, 7, "worked", "stays", 1)))
    again = store.capture(made(spark, 1, "n"), DAY, "daily", 50, 5, model="m")
    findings, runs, hosts, votes = state(store)
    assert findings == [(4, 2, str(DAY), "digest", "d0"), (5, 2, str(DAY), "digest", "d1"), (6, 3, str(DAY), "daily", "n0")]
    assert runs == [(2, str(DAY), "digest", None, None), (3, str(DAY), "daily", 50, 5)] and [r.id for r in again.collect()] == [6]
    assert {f for f, _, _ in hosts} == {4, 5, 6} and [h for f, _, h in hosts if f == 6] == ["h", "g"]
    assert votes == [(4, 7, "worked", "stays")]
    store.capture(made(spark, 0), DAY, "daily")  # a run without findings is a run
    assert [f[0] for f in state(store)[0]] == [4, 5] and len(state(store)[1]) == 2
    assert store.capture(made(spark, 1), DAY, "daily").first().id == 7
    with pytest.raises(ValueError):
        store.capture(made(spark, 1), DAY, "hourly")


def test_a_capture_that_stops_anywhere_leaves_the_old_run(spark, store, monkeypatch):
    store.capture(made(spark, 3), DAY, "daily", 100, 10)
    store.vote(vote(spark, (2, 7, "worked", "", 1)))
    before, stage, publish, writes = state(store), Store.stage, type(store.files).publish, []

    def stopping(limit):
        def at(f):
            def run(*a, **k):
                writes.append(1)
                if len(writes) > limit:
                    raise OSError("stopped")
                return f(*a, **k)

            return run

        return at

    limit = 0
    while True:
        writes.clear()
        with monkeypatch.context() as m:
            m.setattr(Store, "stage", stopping(limit)(stage))
            m.setattr(type(store.files), "publish", stopping(limit)(publish))
            try:
                store.capture(made(spark, 2, "new"), DAY, "daily", 60, 6)
                break
            except OSError:
                pass
        assert state(store) == before
        limit += 1
    assert limit >= 5 and [f[0] for f in state(store)[0]] == [4, 5] and state(store)[3] == []
    assert len(store.vacuum(keep=1, older_than=0)) > limit and [f[0] for f in state(store)[0]] == [4, 5]


def test_of_two_changes_from_one_version_one_is_done_again(spark, store):
    store.capture(made(spark, 1), DAY, "daily")
    base = store.snapshot()
    store.commit(base, {}, {"x": 1})
    with pytest.raises(Conflict):
        store.commit(base, {}, {"x": 2})
    days = [DAY + datetime.timedelta(days=k) for k in range(4)]
    threads = [threading.Thread(target=lambda d=d: Store(spark, store.folder).capture(made(spark, 2), d, "digest")) for d in days]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    ids = [f[0] for f in state(store)[0]]
    assert len(ids) == len(set(ids)) == 9 and store.snapshot().marks["x"] == 1


def test_votes_are_upserted_across_stores(spark, store):
    store.capture(made(spark, 20), DAY, "daily")
    store.vote(vote(spark, (1, 7, "worked", "first", 1), (1, None, "worked", "", 1), (1, 0, "didnt_work", "zero", 1), (9, 7, "worked", "", 1)))
    parts = store.snapshot().tables["votes"]
    Store(spark, store.folder, buckets=99).vote(vote(spark, (1, 7, "didnt_work", "", 2), (1, 7, "worked", "", 1)))
    assert state(store)[3] == [(1, -1, "worked", ""), (1, 0, "didnt_work", "zero"), (1, 7, "didnt_work", "first"), (9, 7, "worked", "")] or \
        sorted(state(store)[3]) == sorted([(1, -1, "worked", ""), (1, -1, "didnt_work", "zero"), (1, 7, "didnt_work", "first"), (9, 7, "worked", "")])
    now = store.snapshot().tables["votes"]
    assert sum(now[k] != parts[k] for k in parts) == 1 and len(parts) == 2  # the other bucket keeps its files
    for wrong in ((1, 7, "maybe", "", 1), (99, 7, "worked", "", 1)):
        with pytest.raises(ValueError):
            store.vote(vote(spark, wrong, (9, 8, "worked", "", 1)))
    assert len(state(store)[3]) == 4


def test_views_verdicts_pool_and_entries(spark, store):
    at = datetime.datetime(2024, 3, 6)
    view = lambda p, s, h: (p, "t", s, "m", False, "e", None, at + datetime.timedelta(hours=h))
    store.save_views(spark.createDataFrame([view("a", 0.5, 0), view("b", 0.1, 0), view("a", 0.7, 1)], store.VIEWS))
    store.save_views(spark.createDataFrame([view("b", None, 0)], store.VIEWS))
    assert sorted((r.program, r.score) for r in store.views().collect() if r.score) == [("a", 0.7)] and store.views().count() == 2
    for k in range(3):
        store.add_verdicts(spark.createDataFrame([("a", "t", "noise", k, at)], store.VERDICTS))
    assert sorted(r.user_id for r in store.verdicts().collect()) == [0, 1, 2]
    shapes = spark.createDataFrame([("a", "t", 1, 1, 1, "x", "h")], "program string, template string, lines long, hosts long, n_days long, example string, example_host string")
    assert store.replace_pool(shapes, DAY) and not store.replace_pool(shapes.limit(0), DAY - datetime.timedelta(days=1))
    assert store.pool().count() == 1 and store.replace_pool(shapes.limit(0), DAY) and store.pool().count() == 0
    entry = lambda p, m: ("*", p, m, "why", "api", None, None, at)
    kinds = store.ENTRIES.removeprefix("id long, ")
    ids = [r.id for r in store.add_entries(spark.createDataFrame([entry("p", ""), entry("", "x")], kinds)).collect()]
    assert sorted(ids) == [1, 2] and store.remove_entry(1) and not store.remove_entry(1)
    with pytest.raises(ValueError):
        store.add_entries(spark.createDataFrame([entry("p", ""), entry("", "")], kinds))
    assert [r.id for r in store.add_entries(spark.createDataFrame([entry("q", "")], kinds)).collect()] == [3] and sorted(r.id for r in store.entries().collect()) == [2, 3]


def test_reads_of_one_finding_and_of_ranges(spark, store):
    for k in range(3):
        store.capture(made(spark, 4, f"r{k}-"), DAY + datetime.timedelta(days=k), "daily", 10, 1)
    one = store.finding(6, "host string, score double")
    assert [(r.title, r.payload.host, r.payload.score) for r in one.collect()] == [("r1-1", "h1", 1.5)] and store.finding(99).count() == 0
    assert len(one.inputFiles()) < len(store.findings().inputFiles()) and all("2024-03-06" in f for f in one.inputFiles())
    last = DAY + datetime.timedelta(days=2)
    assert [r.run_id for r in store.runs(first=last).collect()] == [3] and store.findings(DAY, DAY, "daily").count() == 4 and store.findings(kind="digest").count() == 0
    assert store.flag_budget(last) and not store.flag_budget(last, "digest")
    assert {r.run_id: r.over_budget for r in store.runs().collect()} == {1: False, 2: False, 3: True}


def test_work_is_done_once(spark, tmp_path):
    once, seen, gate = Once(spark, f"file://{tmp_path}/once"), [], threading.Barrier(2, timeout=60)

    def work():
        seen.append(1)

    def attempt(results):
        gate.wait()
        results.append(Once(spark, f"file://{tmp_path}/once").run("2024-03-05", work))

    results = []
    threads = [threading.Thread(target=attempt, args=(results,)) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 1 and results.count("ran") == 1 and once.run("2024-03-05", work) == "done" and once.run("2024-03-05", work, again=True) == "ran"

    def failing():
        raise OSError("no dump")

    with pytest.raises(OSError):
        once.run("2024-03-06", failing)
    assert not once.done("2024-03-06") and once.run("2024-03-06", work) == "ran"
    once.files.publish("dead", "2024-03-07.lease")
    assert once.run("2024-03-07", work) == "held" and not once.done("2024-03-07")
    assert Once(spark, f"file://{tmp_path}/once", lease=-1).run("2024-03-07", work) == "ran"


def test_a_large_day_is_no_single_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siftline.sources.store.FILE", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store, day = Store(spark, f"file://{tmp_path}/large"), datetime.date(2024, 1, 1)
        rows = spark.range(1000).select(
            F.col("id").alias("pos"), F.lit("issue").alias("finding_kind"), F.lit("low").alias("severity"), F.lit("t").alias("title"), F.lit("s").alias("service"), F.array(F.lit("h")).alias("hosts"), F.lit("{}").alias("payload")
        )
        store.capture(rows, day, "daily")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for table, ids in ((store.findings(), "id"), (store.hosts(), "finding_id")):
        assert table.select(F.input_file_name()).distinct().count() > 1 and sorted(r[0] for r in table.select(ids).collect()) == list(range(1, 1001))


def test_given_rows_are_made_once(spark, tmp_path):
    store, day, calls = Store(spark, f"file://{tmp_path}/once"), datetime.date(2024, 1, 1), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    rows = spark.range(5).select(
        F.col("id").alias("pos"), F.lit("issue").alias("finding_kind"), F.lit("low").alias("severity"), F.lit("t").alias("title"), F.lit("s").alias("service"), F.array(F.lit("h")).alias("hosts"), F.lit("{}").alias("payload")
    )
    store.capture(rows, day, "daily")
    said = F.lit("2024-01-01").cast("timestamp").alias("created_at")
    store.vote(spark.range(1, 6).select(F.col("id").alias("finding_id"), F.lit(1).cast("long").alias("user_id"), counted(F.lit("worked")).alias("verdict"), F.lit("").alias("comment"), said))
    assert store.votes().count() == 5 and calls.value <= 5
    calls.value = 0
    views = spark.range(5).select(
        counted(F.col("id").cast("string")).alias("program"), F.lit("t").alias("template"), F.lit(0.5).alias("score"), F.lit("m").alias("score_model"), F.lit(False).alias("refused"),
        F.lit(None).cast("string").alias("explanation"), F.lit(None).cast("string").alias("explain_model"), said,
    )
    store.save_views(views)
    assert store.views().count() == 5 and calls.value <= 5
