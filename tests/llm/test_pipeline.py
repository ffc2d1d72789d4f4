"""The pipeline's stages one after another, and the registration of all queries."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] == seen[3] and seen[4] == seen[5] > 0
    assert docs.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0


def test_stages_on_odd_and_empty_tables(spark, small):
    import corpus_pipeline

    long = " ".join(f"w{k * k % 9973}" for k in range(60_000))
    texts = [None, "", " ", "few words", long, long, long + " tail", "#" * 500, *(f"a clean text number {k} with words enough to stay where it is, {k}" for k in range(4))]
    rows = [(None if k % 5 == 4 else k // 2, t, None if k % 3 else "s", 1, "x", "y") for k, t in enumerate(texts)]
    odd = spark.createDataFrame(rows + rows[:6], "doc_id long, text string, source string, n_chars long, _tx string, lang string")
    for docs in (odd, odd.limit(0)):
        start = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, small)
            assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert bool(start) == bool(docs.count())


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
