"""Scrubbing and its reversal, swaps that are refused, payloads of bounded size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftline.operators import payloads, scrub

TEXTS = "request string, line_no long, text string"


def test_swaps_are_checked():
    assert scrub.read_swaps(" a.org=b.net, x.a.org=c.net,") == [("x.a.org", "c.net"), ("a.org", "b.net")] and scrub.read_swaps("") == []
    for text, prefixes in (("a.org", False), ("=b", False), ("a=b,c=b", False), ("a=b,b=c", False), ("1.2.3.4=9", True), ("300=9", True), ("a=9", True)):
        with pytest.raises(ValueError):
            scrub.read_swaps(text, prefixes)


def test_scrub_and_restore(spark):
    domains, prefixes = scrub.read_swaps("a.org=f.net,x.a.org=g$.net"), scrub.read_swaps("130.209=10.1,130=11", prefixes=True)
    rows = [
        ("r", 9000, "bob@x.a.org, eve@q.com and bob@x.a.org"), ("r", 1, "first eve@q.com on host.a.org"), ("r", 5, None), ("r", 6, ""), ("r", 7, "A.ORG ba.org a.org.example x.a.org"),
        ("r", 8, "130.209.1.2 and 130.1.1.1 and 1130.209.1.1 and 130"), ("s", 1, "eve@q.com"), ("s", 2, "<email-7> stays, <email-1> doesn't"),
    ]
    texts, tokens = scrub.scrubbed(spark.createDataFrame(rows, TEXTS), domains, prefixes)
    got = {(r.request, r.line_no): r.text for r in texts.collect()}
    assert {(r.request, r.number, r.email) for r in tokens.collect()} == {("r", 1, "eve@q.com"), ("r", 2, "bob@x.a.org"), ("s", 1, "eve@q.com")}
    assert got["r", 9000] == "<email-2>, <email-1> and <email-2>" and got["r", 1] == "first <email-1> on host.f.net" and got["r", 5] is None and got["r", 6] == ""
    assert got["r", 7] == "f.net ba.org f.net.example g$.net" and got["r", 8] == "10.1.1.2 and 11.1.1.1 and 1130.209.1.1 and 130"
    back = {(r.request, r.line_no): r.text for r in scrub.restored(texts, tokens, domains, prefixes).collect()}
    want = {(q, n): t for q, n, t in rows}
    assert {k for k in want if back[k] != want[k]} == {("r", 7), ("s", 2)} and back["r", 7] == "a.org ba.org a.org.example x.a.org"
    assert back["s", 2] == "<email-7> stays, eve@q.com doesn't"
    assert scrub.scrubbed(spark.createDataFrame([], TEXTS))[1].count() == 0


def test_numbers_across_blocks(spark):
    """Ten thousand texts with their own address and an old one: numbers are without gaps, in the order of texts."""
    rows = spark.range(10_000).select(F.lit("r").alias("request"), (F.col("id") * 3).alias("line_no"), F.concat(F.lit("u"), F.col("id"), F.lit("@h.org u0@h.org")).alias("text"))
    _, tokens = scrub.scrubbed(rows.repartition(7))
    assert tokens.where("email != concat('u', number - 1, '@h.org')").count() == 0 and tokens.count() == 10_000


def test_packed(spark):
    rows = spark.createDataFrame([(w, n * n, f"{w}{n}") for w in "ab" for n in range(200)], "w string, line_no long, t string")
    got = {(r.w, r.payload): (r.n, r.first, r.text) for r in payloads.packed(rows, 15, "t", "w").collect()}
    assert len(got) == 28 and got["b", 13] == (5, 195**2, "\n".join(f"b{n}" for n in range(195, 200)))
    held = payloads.within_budget(rows, 10, "t", F.length("t"), "w").collect()
    assert max(r.tokens for r in held) <= 10 and sum(r.n for r in held) == 400
    assert [x for r in sorted((r for r in held if r.w == "a"), key=lambda r: r.payload) for x in r.text.split("\n")] == [f"a{n}" for n in range(200)]


def test_fields_and_blocks(spark):
    rows = spark.createDataFrame([("it's",), ('say "it\'s"',), ("a\nb\\",), ("",)], "t string").select(payloads.quoted(F.col("t")).alias("q"))
    assert [r.q for r in rows.collect()] == ['"it\'s"', "'say \"it\\'s\"'", "'a\\nb\\\\'", "''"]
    block = spark.sql("SELECT 'h' AS h, array('x', 'y') AS l UNION ALL SELECT 'h', array()").select(payloads.context_block(F.col("h"), F.col("l")).alias("b"))
    assert sorted(r.b for r in block.collect())[0] == "" and sorted(r.b for r in block.collect())[1].endswith("```\nx\ny\n```\n")
