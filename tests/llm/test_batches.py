"""What Python workers are sent at once, and give back, in plans that the caller runs."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pytest

from siftline.llm import bpe, mixing, queries
from siftline.llm.common import BATCH, relieve

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(texts):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    return max(r.n for r in texts.mapInArrow(run, "n long").collect())


@pytest.fixture
def unlimited(spark):
    before = spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.set(LIMIT, before) if before else spark.conf.unset(LIMIT)


def test_encode_is_sent_long_texts_in_small_batches(unlimited):
    texts = unlimited.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('long ', 100000) AS text")
    assert _largest(texts) > 4 * BATCH
    ids = bpe.encode(texts, queries.vocabulary())
    assert _largest(texts) < 2 * BATCH
    assert {(r.doc_id, len(r.ids)) for r in ids.collect()} == {(k, len(ids.first().ids)) for k in range(40)}


def test_encode_leaves_a_limit_of_the_session(unlimited):
    unlimited.conf.set(LIMIT, "12345678")
    bpe.encode(unlimited.createDataFrame([(1, "a")], "doc_id long, text string"), queries.vocabulary()).collect()
    assert unlimited.conf.get(LIMIT) == "12345678"


def test_workers_of_mixing_give_back_memory(monkeypatch):
    ended = []

    def thrifty(run):
        def whole(batches):
            yield from run(batches)
            ended.append(True)

        return whole

    monkeypatch.setattr(mixing, "thrifty", thrifty, raising=False)
    found = list(mixing._features.func(iter([pd.Series(["a b", None]), pd.Series([], dtype=object)])))
    assert [list(f.tokens) for f in found] == [[2, 0], []] and ended == [True]


def test_executors_collect_their_garbage(spark):
    collected = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    before = collected()
    assert relieve(spark) == spark.sparkContext.defaultParallelism
    assert collected() > before
