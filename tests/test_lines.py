"""Vectors of the line functions, filtering and detectors."""

from __future__ import annotations

import datetime
import statistics
import time

import pytest
from pyspark.sql import functions as F

from siftline.functions import lines as L
from siftline.operators import detect, digest, filtering, library, mgmt, shapes


def lines_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, raw string")


def test_parse(spark):
    texts = [
        "Sep  1 11:37:02 web1 sshd[12]: hello  there ", "Sep 1 11:00:59 h /usr/libexec/x[1]: m", "Sep 1 09:05:00 h kernel: up", "a b c", "", None,
        "Sep 1 11:37:02 h [61685]: x", "Sep 1 1137 h p: x", "Sep 1 11:x7:02 h p: x", "  Sep 1 23:59:01 h cron::  x", "Sep 1 11:75:02 h p: x", "Sep 1 11:37:02 h ",
    ]
    got = {r.line_no: (r.host, r.program, r.bucket) for r in L.parse(lines_of(spark, texts)).collect()}
    none = (None, None, None)
    assert got == {
        0: ("web1", "sshd", "11:30"), 1: ("h", "/usr/libexec/x", "11:00"), 2: ("h", "kernel", "09:00"), 3: none, 4: none, 5: none, 6: none, 7: none, 8: none,
        9: ("h", "cron", "23:50"), 10: ("h", "p", "11:70"), 11: none,
    }
    assert L.parse(lines_of(spark, texts)).where("line_no = 0").first().rest == "sshd[12]: hello  there "


def test_mask(spark):
    rows = [
        ("refused for invalid user q7 from 192.0.2.44 twice in 30 s", "", "refused for invalid user <user> from <ip> twice in <n> s"),
        ("mail to a.b+c@example.org done", "", "mail to <email> done"), ("at web1 and web1.example.net now", "web1.example.net", "at <host> and <host> now"),
        ("id 0123456789abcdef0123 seen", "", "id <hex> seen"), ("addr fe80::1 and 1:2:3:4:5:6:7:8", "", "addr <ip6> and <ip6>"), ("time 12:34:56 v1.2.3", "", "time <n>:<n>:<n> <fqdn>"),
        ("version 1.2.3 of a.b.c", "", "version <n>.<n>.<n> of <fqdn>"), ("User=alice x", "", "User=<user> x"), ("raw <6> 7", "", "raw <6> <n>"), ("", "", ""),
    ]
    df = spark.createDataFrame(rows, "m string, h string, want string").select(L.mask(F.col("m"), F.col("h")).alias("got"), "want")
    assert [r.got for r in df.collect()] == [w for _, _, w in rows]


@pytest.mark.parametrize("glob,text,fits", [("*", "abc", True), ("*", "a/b", False), ("web?", "web1", True), ("web?", "web12", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), (r"\*", "*", True), ("[", "[", False), ("a.b", "axb", False), ("", "", True)])
def test_glob(spark, glob, text, fits):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(L.glob_regex(glob))).first()[0] is fits


def test_filter_and_collapse(spark):
    head = "Sep  1 10:00:0{} h{} app[{}]: {}"
    texts = [head.format(k, k % 3, k, "disk full") for k in range(8)] + ["short line", "short line", head.format(9, 1, 1, "once 5")]
    lines = lines_of(spark, texts)
    kept = [r.line_no for r in filtering.cap_repeats(lines).orderBy("line_no").collect()]
    assert kept == [0, 1, 2, 8, 9, 10]
    spread = {r.key: r.hosts for r in filtering.spread(lines).collect()}
    assert spread == {"app: disk full": 3, "short line": 0, "app: once 5": 1}
    tagged = [r.raw for r in filtering.tag_spread(filtering.collapse(lines), filtering.spread(lines)).orderBy("line_no").collect()]
    assert tagged[0] == "[on 3 hosts] [x3 10:00:00-10:00:06] " + texts[0] and tagged[3:5] == ["short line", "short line"]
    assert spark.createDataFrame([(tagged[0],)], "t string").select(L.untag(F.col("t"))).first()[0] == texts[0]
    rules = [filtering.Rule(2, match="full$"), filtering.Rule(1, host="h1", program="ap*"), filtering.Rule(3, program="*", expires=datetime.date(2020, 1, 1))]
    now = filtering.active(rules, datetime.date(2024, 1, 1))
    ids = {r.line_no: r.rule_id for r in filtering.with_rule(lines, now).collect()}
    assert ids == {0: 2, 1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 6: 2, 7: 1, 8: None, 9: None, 10: 1}
    assert filtering.with_rule(lines, []).where("rule_id IS NOT NULL").count() == 0


def plain_z(x, population):
    med = statistics.median(population)
    off = [abs(v - med) for v in population]
    mad, mean = statistics.median(off), sum(off) / len(off)
    return 0.6745 * (x - med) / mad if mad else (x - med) / (1.253 * mean) if mean else 0.0


@pytest.mark.parametrize("values", [[31, 28, 35, 30, 902, 29, 33], [7, 7, 7], [2, 2, 2, 2, 2, 2, 81]])
def test_peer_scores(spark, values):
    totals = spark.createDataFrame([(f"h{k}", "p", v) for k, v in enumerate(values)], "host string, program string, n long")
    got = {r.host: r.score for r in detect.peer_scores(totals).collect()}
    assert got == pytest.approx({f"h{k}": plain_z(v, values) for k, v in enumerate(values)})


def test_baseline_directions(spark):
    history = [211 + 17 * (k % 4) - 9 * (k % 3) for k in range(11)]
    day = datetime.date(2024, 6, 13)
    today = {"loud": 9 * max(history), "low": min(history) // 8, "same": history[0]}
    rows = [(p, day - datetime.timedelta(days=12 - k), n) for p in ("loud", "gone", "low", "same") for k, n in enumerate(history)]
    rows += [(p, day, n) for p, n in today.items()] + [("new", day, 900)]
    counts = spark.createDataFrame([("h", p, "10:00", d, n) for p, d, n in rows], "host string, program string, bucket string, log_date date, n long")
    scores = detect.baseline_scores(counts, day)
    assert {r.program: r.score for r in scores.collect()} == pytest.approx({p: plain_z(x, history) for p, x in (today | {"gone": 0}).items()})
    assert {r.program: r.direction for r in detect.baseline_anomalies(scores).collect()} == {"loud": "louder", "gone": "silent", "low": "quieter"}
    burst = detect.temporal_anomalies(detect.temporal_scores(counts, day))
    assert [r.program for r in burst.collect()] == ["loud"]
    peer = spark.createDataFrame([("h", "loud", 3.0), ("h", "only", 9.0)], "host string, program string, score double")
    found = {r.program: r.kind for r in detect.combine(peer, detect.baseline_anomalies(scores), burst).collect()}
    assert found == {"loud": "baseline", "only": "peer", "gone": "baseline", "low": "baseline"}


def test_votes(spark):
    schema = "finding_id long, user_id long, verdict string, comment string, created_at int"
    old = spark.createDataFrame([(1, 5, "worked", "fine", 1), (1, None, "worked", "", 1), (2, 5, "worked", "x", 1)], schema)
    new = spark.createDataFrame([(1, 5, "didnt_work", "", 2), (3, None, "worked", "c", 2)], schema)
    got = {(r.finding_id, r.user_id): (r.verdict, r.comment, r.created_at) for r in library.merge_votes(old, new).collect()}
    assert got == {(1, 5): ("didnt_work", "fine", 2), (1, None): ("worked", "", 1), (2, 5): ("worked", "x", 1), (3, None): ("worked", "c", 2)}
    # a comment, then none: the newer of the comments stays, as if they came in one by one
    twice = spark.createDataFrame([(1, 5, "didnt_work", "newer", 2), (1, 5, "worked", "", 3)], schema)
    got = {(r.finding_id, r.user_id): (r.verdict, r.comment) for r in library.merge_votes(old, twice).collect()}
    assert got[1, 5] == ("worked", "newer")
    left = {(r.finding_id, r.user_id) for r in library.reassign_votes(old, 5).collect()}
    assert left == {(1, None), (2, None)}


def test_clusters_and_empty_windows(spark):
    known = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    proposed = spark.createDataFrame([(7, 1), (8, 1), (7, 2), (9, 99)], "cluster long, id long")
    got = {r.id: r.cluster for r in digest.repair_clusters(proposed, known).collect()}
    assert got[1] == got[2] == 7 and got[3] < 0
    assert digest.days(spark, "2024-01-03", "2024-01-01").count() == 0 and digest.days(spark, "2024-01-01", "2024-01-03").count() == 3
    assert library.page(spark.createDataFrame([], "id long, log_date date")).count() == 0


def test_context_is_clipped_and_by_host(spark):
    lines = spark.createDataFrame([(k, "ab"[k % 2], f"l{k}") for k in range(10)], "line_no long, host string, raw string")
    got = sorted(r.line_no for r in shapes.context(lines, spark.createDataFrame([(2,)], "anchor long"), 2).collect())
    assert got == [0, 2, 4, 6]


def test_a_line_is_split_once(spark):
    lines = lines_of(spark, ["Sep 1 11:37:02 h p[1]: x"]).withColumn("log_date", F.lit("2024-01-01").cast("date"))
    for df, most in ((detect.window_counts(L.parse(lines)), 3), (filtering.spread(lines), 2), (filtering.with_rule(lines, [filtering.Rule(1, match="x")]), 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 0 and plan.count("regexp_extract(raw") <= most


def test_chunks_are_full_after_filtering(spark):
    gaps = spark.createDataFrame([(k, "x") for k in range(0, 50_000, 7) if k % 11], "line_no long, raw string")
    sizes = {r.chunk: r["count"] for r in shapes.chunks(gaps).groupBy("chunk").count().collect()}
    total = gaps.count()
    assert sizes == {k: min(250, total - 250 * k) for k in range(-(-total // 250))}


def test_anchor_reads_as_the_example_first(spark):
    raw = [" a b c d p: x y z w", "a b c d p: x y", "a b c d p: x y  ", "a b c d p: q"]
    lines = spark.createDataFrame([(k, "d", "p", r) for k, r in enumerate(raw)], "line_no long, host string, program string, raw string")
    examples = spark.createDataFrame([("one", "d", "p", "a b c d p: x y "), ("two", "d", "p", "a b c d p: q q v"), ("none", "e", "p", "v")], "example_id string, host string, program string, raw string")
    got = {r.example_id: (r.line_no, r.exact) for r in shapes.anchors(lines, examples).collect()}
    assert got == {"one": (1, True), "two": (3, False)}


def test_a_day_with_two_kinds_of_run_is_one_row(spark):
    day = datetime.date(2024, 3, 1)
    runs = spark.createDataFrame([(1, day, 100, 10, "daily"), (2, day, None, None, "digest")], "run_id long, log_date date, raw_lines long, filtered_lines long, kind string")
    findings = spark.createDataFrame([(1, 1, day), (2, 2, day), (3, 1, day)], "id long, run_id long, log_date date")
    counts = spark.createDataFrame([("h", "p", "10:00", 5, day)], "host string, program string, bucket string, n long, log_date date")
    rows = mgmt.day_rows(runs, counts, findings, "2024-03-01", "2024-03-02").orderBy("day").collect()
    assert [(r.volume, r.filtered_lines, r.n_findings) for r in rows] == [(100, 10, 2), (None, None, 0)]


def test_letters_beyond_ascii_keep_their_case(spark):
    findings = spark.createDataFrame([(1, "ÄRGER Disk"), (2, "ärger disk")], "id long, title string")
    hosts = spark.createDataFrame([], "finding_id long, host string, pos int")
    assert [r.id for r in library.search(findings, hosts, title="ärger DISK").collect()] == [2]


def test_java_regex(spark):
    cases = [
        (r"(?P<n>[0-9]+)x", "12x", True), (r"^[[:digit:]]+$", "123", True), (r"^[[:^digit:]]+$", "1a", False), (r"a\sb", "a\x0bb", False), (r"a[\s]b", "a\tb", True),
        (r"^[\S-]+$", "a-b", True), (r"\[[a&&b]\]", "[&]", True), (r"^[a[]+$", "a[", True), (r"[]x]", "]", True), (r"a\vb", "a\x0bb", True), (r"\Qa.b\E$", "a.b", True), (r"\bup\b", "is up now", True),
    ]
    row = spark.createDataFrame([tuple(text for _, text, _ in cases)], [f"c{k}" for k in range(len(cases))])
    got = row.select(*[F.col(f"c{k}").rlike("(?md)" + L.java_regex(p)).alias(f"c{k}") for k, (p, _, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, _, want in cases]
    for bad in (r"(a)\1", "a(?=b)", "(?<!a)b", "(?>a)", "x\\"):
        with pytest.raises(ValueError):
            L.java_regex(bad)


def test_mask_secrets(spark):
    cases = {
        "password=hunter2 ok": "password=**** ok", 'api_key: "a b", next': "api_key: ****, next", "Authorization: Bearer abcdefgh12345": "Authorization: Bearer ****",
        "GET https://u:p4ss@h/x": "GET https://u:****@h/x", "key AKIA" + "A" * 16 + " used": "key **** used", "passwords were changed; token ring": "passwords were changed; token ring", "": "", None: None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", L.mask_secrets(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in got} == cases


def test_sample(spark):
    pool = spark.createDataFrame([("p", f"t{k}") for k in range(30)], "program string, template string")
    once, again = ([r.template for r in shapes.sample(pool, 10, 7).collect()] for _ in range(2))
    assert once == again and len(set(once)) == 10
    assert shapes.sample(pool, 50).count() == 30 and shapes.sample(pool.limit(0)).count() == 0


def test_masks_of_long_runs(spark):
    """Patterns that are tried at every place find what plain ones do, and a run of 300,000 characters takes no square of steps."""
    alphabet, texts = ["a", "f", "7", "1", ".", "-", "_", ":", "::", "@", "+", "%", " ", "<", ">", "user=", "for ", "0123456789abcde", "a.b", "1.2.3.4", "x@y.z"], []
    state = 1
    for _ in range(4000):
        text = ""
        for _ in range(12):
            state = state * 6364136223846793005 % 2**64 + 1442695040888963407
            text += alphabet[(state >> 33) % len(alphabet)]
        texts.append(text)
    w, h = "[0-9A-Za-z_-]", "[0-9a-fA-F]{1,4}"
    plain = {
        "EMAIL": r"[0-9A-Za-z_.+%-]+@[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]+)+", "IPV4": rf"{L.EDGE}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{L.EDGE}",
        "IPV6": rf"{L.EDGE}(?:{h}:){{5,7}}{h}{L.EDGE}|(?:{h}(?::{h}){{0,6}})?::(?:{h}(?::{h}){{0,6}})?",
        "FQDN": rf"{L.EDGE}(?=(?:[0-9_-]|\.(?={w}))*[A-Za-z]){w}++(?:\.{w}+){{2,}}{L.EDGE}", "HEX": rf"{L.EDGE}[0-9a-fA-F-]{{16,}}{L.EDGE}",
        "USER": rf"(?i){L.EDGE}(user[= ])([^\t\n\f\r ]+)", "FOR_USER": rf"{L.EDGE}for (invalid user )?([^\t\n\f\r ]+) from{L.EDGE}",
    }
    found = lambda p: F.regexp_replace("t", p, "!")
    pieces = F.transform(F.regexp_extract_all("t", F.lit("<[a-z0-9]+>|[0-9]+|[^<0-9]+|<"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]+$"), "<n>").otherwise(p))
    same = [found(getattr(L, name)) == found(p) for name, p in plain.items()] + [F.regexp_replace("t", L.NUMBER, "$1<n>") == F.array_join(pieces, "")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array(*same).alias("same"))
    assert rows.where(F.exists("same", lambda s: ~s)).count() == 0
    long = spark.range(1).select(F.concat(F.lit("b@c.de "), F.repeat(F.lit("q"), 300_000), F.lit(" 7 "), F.repeat(F.lit("5"), 20_000), F.lit(" 1.b.c")).alias("t"))
    begun = time.monotonic()
    got = long.select(L.mask(F.col("t"), F.lit(""))).first()[0]
    assert got == "<email> " + "q" * 300_000 + " <n> <hex> <fqdn>" and time.monotonic() - begun < 30
