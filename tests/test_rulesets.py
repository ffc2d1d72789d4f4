"""Many rules by an index against all rules one after another."""

from __future__ import annotations

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from siftline.operators import filtering, rulesets
from siftline.operators.filtering import Rule


@pytest.mark.parametrize(
    "pattern,want",
    [
        ("disk full", ["disk full"]), ("(?i)Disk .* FULL!", [" full!"]), ("a(bc)d|xyz1", ["abcd", "xyz1"]), ("(foobar|barbaz) ok", ["foobar", "barbaz"]), (r"\d+ (?:err)+", ["err"]),
        ("(abc)*de", None), ("a|bcdef", None), (r"\Qa.b.c\E", None), ("[[:alpha:]]abcd", None), ("x?y", None), ("(", None), ("ab[cd]efgh", ["efgh"]), ("", None), ("é.ÀBC", ["Àbc"]),
    ],
)
def test_required_literals(pattern, want):
    assert rulesets.required_literals(pattern) == want


def test_two_thousand_rules(spark):
    rng = random.Random(3)
    words = ["disk", "full", "session", "opened", "closed", "error", "Timeout", "retry", "link", "down", "kernel", "oops"]
    rows = [(k, f"Jan {k % 28 + 1:2d} 10:00:00 host{k % 40} prog{k % 30}[{k}]: {' '.join(rng.choice(words) + str(rng.randrange(60)) for _ in range(6))}") for k in range(2500)]
    rows += [(9000, "too few fields"), (9001, None), (9002, ""), (9003, "Jan  1 10:00:00 a/b prog1: disk1 full1")]
    lines = spark.createDataFrame(rows, "line_no long, raw string").repartition(4).withColumn("day", F.lit(datetime.date(2024, 1, 5)))
    rules = []
    for k in range(2000):
        a, b = (rng.choice(words) + str(rng.randrange(60)) for _ in range(2))
        rules.append(rng.choice([
            Rule(k, match=rf"{a} .*{b}"), Rule(k, f"host{k % 50}", match=rf"(?i){a.upper()}\b"), Rule(k, "host1?", match=rf"^prog{k % 40}\[\d+\]: {a}"), Rule(k, f"host{k % 60}", f"prog{k % 35}"),
            Rule(k, match=rf"({a}|{b}) \w+$", expires=datetime.date(2024, 1, 1 + k % 9)), Rule(k, match=r"zz?\d"), Rule(k, "*", f"pr?g{k}*"),
        ]))
    seconds, found = {}, {}
    for name, few in (("index", 0), ("chain", 10_000)):
        filtering.MANY, kept = few, filtering.MANY
        try:
            began = time.time()
            found[name] = {r.line_no: r.rule_id for r in filtering.with_rule(lines, rules, day=F.col("day")).select("line_no", "rule_id").collect()}
            seconds[name] = time.time() - began
        finally:
            filtering.MANY = kept
    assert found["index"] == found["chain"] and len(set(found["index"].values())) > 150
    print(seconds)
    assert seconds["index"] < seconds["chain"], seconds
