"""Components of graphs of several shapes, and how many plans the driver makes for them."""

from __future__ import annotations

import numpy as np
import pytest

from siftline.llm import components as module
from siftline.llm import neardup
from siftline.llm.components import components


def plain(edges):
    """The smallest node that each node reaches."""
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    while True:
        before = dict(least)
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def plans(spark):
    """SQL executions so far, whose plans and metrics the driver keeps."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def graphs():
    rng = np.random.default_rng(5)
    order = rng.permutation(400) - 100
    yield "path", list(zip(order.tolist(), order[1:].tolist()))
    yield "random", rng.integers(0, 500, (300, 2)).tolist()
    yield "hub", [(50, k) for k in range(100)] + [(7, 7), (3, 50), (50, 3)]


@pytest.mark.parametrize("name, edges", list(graphs()))
@pytest.mark.parametrize("at_once", [module.AT_ONCE, 1])
def test_components(spark, name, edges, at_once, monkeypatch):
    made = spark.createDataFrame([tuple(e) for e in edges] + [(None, 1)], "a long, b long").repartition(5)
    apart = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    if at_once == 1:  # tasks unite three edges at a time, so that steps of several tasks are needed
        monkeypatch.setattr(module, "AT_ONCE", 1)
        monkeypatch.setattr(module, "_contracted", of_three(module._contracted))
        for k, v in apart.items():
            spark.conf.set(k, v)
    try:
        got = [(r.node, r.component) for r in components(made, "a", "b").collect()]
    finally:
        for k in apart:
            spark.conf.unset(k)
    assert len(got) == len(set(got)) and dict(got) == plain(edges)


def of_three(contracted):
    """``contracted`` with tasks that unite a few edges at once, which workers do not see from a patched constant."""

    def few(batches):
        for batch in batches:
            for at in range(0, len(batch), 3):
                yield from module._stars(iter([batch.slice(at, 3)]))

    def run(edges):
        near = edges.select("u", "v").mapInArrow(few, "u long, v long")
        return near.repartition("u").mapInArrow(few, "u long, v long")

    return run


def test_few_plans_for_small_graphs(spark):
    edges = [(k + 1, k) for k in range(300)]
    made = spark.createDataFrame(edges, "u long, v long")
    before = plans(spark)
    got = components(made)
    assert plans(spark) - before <= 2  # the edges, and whether they are settled
    assert {r.component for r in got.collect()} == {0} and got.count() == 301


def test_few_plans_for_near_duplicates(spark):
    """The driver keeps the plans and metrics of a thousand executions; a run of near_dedup left some hundred."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(40):
        text = rng.choice(words, 80).tolist()
        for c in range(4):
            rows.append((4 * k + c, " ".join(text[:-c] + ["x"] * c if c else text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = plans(spark)
    neardup.near_duplicate_groups(docs)
    assert plans(spark) - before < 60
