"""The whole pipeline against its stages done one after another in plain Python (rates alone are the library's)."""

from __future__ import annotations

import glob
import os
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from siftline.llm import mixing, quality, queries
from tests.conftest import TESTDATA
from tests.llm.test_operators import lower, plain_counts, plain_groups, words_of


def after_quality(docs):
    """Documents that pass, without lines that over 20 texts and 0.5 % of the texts of their host share, but in the first document."""
    each, texts, first, of = {}, defaultdict(set), {}, defaultdict(set)
    for i, (text, source) in docs.items():
        lines = [(line, " ".join(words_of(lower(line)))) for line in text.split("\n")]
        content, host, failed = " ".join(words_of(lower(text))), source or "", plain_counts(text)[5]
        each[i] = lines, host, failed
        of[host].add(content)
        for _, norm in lines:
            if norm:
                texts[host, norm].add(content)
                if not failed:
                    first[host, norm] = min(first.get((host, norm), i), i)
    common = {k for k, t in texts.items() if len(t) > quality.MOST_TEXTS and len(t) > quality.MOST_SHARE * len(of[k[0]])}
    out = {}
    for i, (lines, host, failed) in each.items():
        gone = {norm for _, norm in lines if (host, norm) in common and first.get((host, norm)) != i}
        left = plain_counts(docs[i][0])[0] - sum(len(norm.split(" ")) for _, norm in lines if norm in gone)
        if not failed and left >= quality.FEWEST:
            out[i] = "\n".join(line for line, norm in lines if norm not in gone) if gone else docs[i][0]
    return out, len(common)


def after_repeats(docs, length=200):
    """Texts without the characters that strings of 200 bytes cover which start elsewhere too."""
    data = {i: t.encode() for i, t in docs.items()}
    seen = Counter(hash(d[k : k + length]) for d in data.values() for k in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, np.int64)
        for k in range(len(d) - length + 1):
            if seen[hash(d[k : k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        kept = np.cumsum(gone[:-1]) == 0
        out[i] = bytes(np.frombuffer(d, np.uint8)[kept]).decode("utf-8", "ignore")
    return out


def test_whole_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    small, rng = f"file://{tmp_path}", np.random.default_rng(1)
    plain = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    menu = "Home  About us\nNews and more of it"  # lines that thirty documents of a host share
    made = [(900_000 + k, f"{menu}\n" + " ".join(rng.choice([f"word{w}" for w in range(2000)], 12 if k else 3)), "en", "menus", 1) for k in range(30)]
    plain.unionByName(spark.createDataFrame(made, plain.schema)).write.parquet(f"{small}/documents.parquet")
    spark.read.parquet(f"{TESTDATA}/sf0.01/labels.parquet").write.parquet(f"{small}/labels.parquet")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*/*"))
    frame = spark.read.parquet(f"{small}/documents.parquet")
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, small).collect())
    left = {os.path.basename(p) for p in set(glob.glob(f"{folder}/*/*")) - before}
    assert left == {"encode"}  # tables of stages are deleted

    docs = {r.doc_id: (r.text or "", r.source) for r in frame.collect()}
    texts, common = after_quality(docs)
    assert common == 2 and len(texts) < len(docs) and sum("About us" in t for t in texts.values()) < 30
    groups = plain_groups(texts.items())
    texts = after_repeats({i: t for i, t in texts.items() if groups[i] == i})
    rest = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    copies = Counter(r.doc_id for r in mixing.mixed(rest, mixing.label_domains(spark.read.parquet(f"{small}/labels.parquet"))).select(F.col("doc_id")).collect())
    tok = Tokenizer.from_file(queries.vocabulary())
    tok.no_truncation(), tok.no_padding()
    want = Counter()
    for i, n in copies.items():
        ids = tok.encode(texts[i], add_special_tokens=False).ids
        want[i, len(ids), np.array(ids, "<u4").tobytes()] += n
    assert {(i, n, x) for i, n, x in got} == set(want) and got == want
