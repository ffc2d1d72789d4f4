"""Reading line files and dumps, the store's replacements, and counts as a stream."""

from __future__ import annotations

import datetime
import gzip
import json

import pytest
from pyspark.sql import functions as F

from siftline.sources import logs
from siftline.sources.store import Store
from siftline.streaming import windows

DAY = datetime.date(2024, 3, 5)


def test_lines_keep_their_order(spark, tmp_path):
    texts = [f"line {k}\r" if k % 7 == 0 else f"line {k}" for k in range(5000)]
    (tmp_path / "a.log").write_bytes("\n".join(texts).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.raw for r in sorted(rows, key=lambda r: r.line_no)] == texts
    assert sorted(r.line_no for r in rows) == list(range(1, 5001))


def test_documents(spark, tmp_path):
    docs = [
        {"@timestamp": "2024-06-30T23:30:00Z", "host.hostname": "web1", "process.name": "sshd", "process.pid": 12, "message": "a\nb", "host.os.name": "Ubuntu", "host.os.version": "22.04 LTS"},
        {"@timestamp": "2024-01-05T08:00:00+01:00", "host.name": "db.example.org", "process.name": None, "process.pid": None, "message": "x"},
        {"@timestamp": "2024-01-05T08:00:00Z", "message": "no host"}, {"message": "no time"}, {"@timestamp": "2024-01-05T08:00:00Z", "message": ""},
    ]
    (tmp_path / "2024-03-05.ndjson.gz").write_bytes(gzip.compress("\n\n".join(map(json.dumps, docs)).encode()))
    (tmp_path / "2024-03-04.ndjson.gz").write_bytes(b"")
    paths, missing = logs.day_paths(spark, str(tmp_path), DAY, 3)
    assert len(paths) == 1 and missing == [datetime.date(2024, 3, 3), datetime.date(2024, 3, 4)]
    got = [(r.raw, str(r.log_date), r.os) for r in logs.read_documents(spark, paths).orderBy("line_no").collect()]
    assert got == [("Jul  1 00:30:00 web1 sshd[12]: a b", "2024-07-01", "Ubuntu 22.04"), ("Jan  5 07:00:00 db None: x", "2024-01-05", None), ("Jan  5 08:00:00 unknown unknown: no host", "2024-01-05", None)]
    (tmp_path / "bad.ndjson").write_text("{}\nnot json\n")
    with pytest.raises(Exception, match="line 2 is no JSON object"):
        logs.read_documents(spark, str(tmp_path / "bad.ndjson")).collect()


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.counts().count() == 0 and store.prune(DAY) == []
    counts = lambda n: spark.createDataFrame([("h", "p", "10:00", n)], "host string, program string, bucket string, n long")
    store.replace_day(counts(1), DAY), store.replace_day(counts(2), DAY), store.replace_day(counts(3), datetime.date(2023, 1, 1))
    assert sorted((r.n, str(r.log_date)) for r in store.counts().collect()) == [(2, "2024-03-05"), (3, "2023-01-01")]
    assert store.prune(DAY) == ["2023-01-01"]
    store.replace_day(counts(1).limit(0), DAY)
    assert store.counts().count() == 0


def test_a_stream_replaces_the_days_it_touches(spark, tmp_path):
    """A late file and a batch that is done again give what a batch over all files gives."""
    store, lines = Store(spark, f"file://{tmp_path}/store"), f"{tmp_path}/in"
    schema = "line_no long, raw string, log_date date"
    rows = lambda day, n, tag: spark.createDataFrame([(k, f"Mar  {day} 10:0{k % 6}:00 h{tag} p[{k}]: m", datetime.date(2024, 3, day)) for k in range(n)], schema)
    whole = lambda days: spark.read.schema(schema).parquet(lines)
    run = lambda checkpoint: windows.replace_days(spark.readStream.schema(schema).parquet(lines), whole, store, f"{tmp_path}/{checkpoint}").awaitTermination(120)
    seen = lambda: sorted((str(r.log_date), r.host, r.n) for r in store.counts().groupBy("log_date", "host").agg(F.sum("n").alias("n")).collect())
    rows(5, 10, "a").unionByName(rows(6, 4, "a")).write.mode("append").parquet(lines)
    run("ck")
    assert seen() == [("2024-03-05", "ha", 10), ("2024-03-06", "ha", 4)]
    parts = store.snapshot().tables["counts"]
    rows(5, 3, "late").write.mode("append").parquet(lines)
    run("ck")
    assert seen() == [("2024-03-05", "ha", 10), ("2024-03-05", "hlate", 3), ("2024-03-06", "ha", 4)]
    assert store.snapshot().tables["counts"]["2024-03-06"] == parts["2024-03-06"]  # a day that isn't touched keeps its files
    run("another")  # everything again
    assert seen() == [("2024-03-05", "ha", 10), ("2024-03-05", "hlate", 3), ("2024-03-06", "ha", 4)]


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:0{m}:00", "h", "p") for h in range(6) for m in (1, 3, 9)]
    spark.createDataFrame(rows, "ts string, host string, program string").select(F.to_timestamp("ts").alias("ts"), "host", "program").write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("ts timestamp, host string, program string").parquet(f"{tmp_path}/in")
    windows.write_windows(windows.window_counts(events), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.start.hour for r in got} >= {0, 1, 2, 3} and all(r.n == 3 for r in got)


def test_flattened(spark):
    cases = {
        '{"message":"m <b>","host":{"name":"h","os":{"version":null}},"@timestamp":"t","process":{"pid":12}}': '{"@timestamp":"t","host.name":"h","process.pid":12,"message":"m <b>"}',
        '{"host":"plain","host.name":"dotted","message":["a",true]}': '{"message":["a",true]}', "{}": "{}", "no json": None, None: None,
    }
    got = logs.flattened(spark.createDataFrame([(k,) for k in cases], "raw string")).collect()
    assert {r.raw: r.flat for r in got} == cases
