"""What near_dedup and repeated_strings put on disk, tables and shuffles, against the texts that they are given."""

from __future__ import annotations

import glob
import os
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import common, neardup


def shuffled(spark):
    """Bytes that stages have written for others so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}


def moved(spark, run):
    """Bytes that ``run`` shuffles."""
    before = shuffled(spark)
    run()
    return sum(n for k, n in shuffled(spark).items() if k not in before)


def families(rng, count, size, own, shared):
    """Texts of ``own`` words and a passage that each of a family has; none are near copies."""
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    for _ in range(count):
        passage = rng.choice(vocabulary, shared).tolist()
        for _ in range(size):
            yield " ".join(rng.choice(vocabulary, own).tolist() + passage)


def test_near_dedup_takes_less_disk_than_its_texts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(21)
    texts = list(families(rng, 5, 24, 900, 600))
    near = [t.replace(" w", " v", 3) for t in texts[:9]]  # near copies, whose sets are compared
    rows = [(k, t) for k, t in enumerate(texts + near + texts[:7])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/docs")
    docs, size, tables = spark.read.parquet(f"file://{tmp_path}/docs"), sum(len(t) for _, t in rows), Counter()

    def kept(df, label, write=common.materialise):
        out = write(df, label)
        tables[label] += sum(map(os.path.getsize, glob.glob(f"{out._siftline_path.removeprefix('file://')}/*.parquet")))
        return out

    monkeypatch.setattr(neardup, "materialise", kept)
    # as with more texts than are broadcast, and than frequent shingles are learned from
    monkeypatch.setattr(neardup, "SAMPLE", 10)
    monkeypatch.setattr(neardup, "small", lambda df, most=60, rows=None: common.small(df, most, rows))
    out = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    crossed = moved(spark, lambda: out.extend(r.doc_id for r in neardup.drop_near_duplicates(docs).select("doc_id").collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(out) == list(range(len(texts)))
    assert sum(tables.values()) < 0.6 * size and crossed < 5 * size, (sum(tables.values()) / size, crossed / size)


def test_parities_never_differ_in_more_than_the_sets(spark):
    rng = np.random.default_rng(22)
    rows = []
    for n in (0, 1, 255, 256, 257, 500, 513, 1000, 3000):
        for part in (0.0, 0.02, 0.2, 0.5, 1.0):
            one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            for more in (0, n // 4, 3 * n):
                other = np.concatenate((one[: n - int(part * n)], rng.integers(0, 1 << 63, more, dtype=np.uint64)))
                rows.append((neardup.parities(one).tolist(), neardup.parities(other).tolist(), len(set(one.tolist()) ^ set(other.tolist()))))
    made = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    got = made.select("a", "b", "n", neardup.differing(F.col("a"), F.col("b")).alias("d"), neardup.differing(F.col("b"), F.col("a")).alias("e")).collect()
    assert all(r.d == r.e and r.d <= r.n for r in got)
    for n in (256, 500, 513, 1000, 3000):  # those without anything in common differ in more than sets that are alike can, a fifth of n
        one, other = (neardup.parities(rng.integers(0, 1 << 63, n, dtype=np.uint64)).view(np.uint64) for _ in range(2))
        assert np.bitwise_count(one ^ other).sum() > 0.35 * n


def test_near_dedup_without_broadcasts(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.union(docs.limit(20)).union(docs.limit(9).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(12).withColumn("doc_id", F.col("doc_id") - 5))
    rows = lambda: Counter(map(str, neardup.drop_near_duplicates(odd).collect()))
    want = rows()
    monkeypatch.setattr(neardup, "small", lambda df, most=0, rows=None: df)
    assert rows() == want and sum(want.values()) < odd.count()
