"""Hard negatives, centroid clustering and the additive quality model against brute force and held-out labels."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import gam, negatives, queries, yinyang
from tests.conftest import TESTDATA

VECTORS = "vec_id long, embedding array<float>, label int, id string, q string, rank int"


def plain_negatives(rows, scale=256, positives=5, negatives=5, percent=80):
    """rows of (id, vector, label); every anchor against every row."""
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        r = (label, [int(np.floor(scale * float(np.float32(c)))) for c in v])
        own[i] = min(own.get(i, r), r)
    out = set()
    for a, (la, qa) in own.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(qa, q)) for i, (_, q) in own.items() if len(q) == len(qa) and i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if own[i][0] == la][:positives]:
            fit = [i for i in order if own[i][0] != la and percent * score[p] <= 100 * score[i] <= 100 * score[p]][:negatives]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(fit, 1)}
    return out


def odd_vectors(dim=64):
    rng = np.random.default_rng(11)
    middle = rng.standard_normal((4, dim))
    rows = []
    for k in range(700):
        v = middle[rng.integers(4)] + rng.standard_normal(dim) * rng.choice([0.0, 0.2, 1.0])
        rows.append((k, (v / np.linalg.norm(v) * rng.choice([1.0, 1.0, 3.0])).tolist(), 0 if k % 3 == 0 else int(rng.integers(3)), "clash", "clash", 7))
    one = rows[100][1]
    rows += [
        (1000, None, 1, None, None, None), (1100, [None] * dim, 1, None, None, None), (1200, [float("nan")] + [1.0] * (dim - 1), 1, None, None, None),
        (1300, [float("inf")] * dim, 1, None, None, None), (1400, [0.0] * dim, 1, None, None, None), (1500, [], 0, None, None, None), (1501, [], 0, None, None, None),
        (1502, [], 1, None, None, None), (None, one, 0, None, None, None), (1600, one, None, None, None, None), (1700, [1.0, 2.0], 0, None, None, None),
        (1701, [1.0, 2.0], 0, None, None, None), (1702, [0.9, 2.0], 2, None, None, None), (1703, [0.9, 2.0], 2, None, None, None), (100, one, 0, None, None, None),
        (1801, one, 2, None, None, None), (1802, one, 2, None, None, None), (1900, (-np.array(one)).tolist(), 1, None, None, None),
    ]
    return rows


@pytest.mark.parametrize("numbers,anchors,at_once", [(negatives.NUMBERS, negatives.ANCHORS, negatives.AT_ONCE), (64 * 256, 3, 50)])
def test_hard_negatives(spark, monkeypatch, numbers, anchors, at_once):
    monkeypatch.setattr(negatives, "NUMBERS", numbers)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "AT_ONCE", at_once)
    rows = odd_vectors()
    got = [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()]
    want = plain_negatives([r[:3] for r in rows])
    assert len(got) == len(set(got)) and set(got) == want and len({r[0] for r in want}) >= 6


def test_hard_negatives_with_other_anchors_and_counts(spark):
    rows = odd_vectors()[:300]
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), is_anchor=F.col("id") == 200, positives=2, negatives=500, percent=50, scale=100)
    assert {tuple(r) for r in found.collect()} == {r for r in plain_negatives([r[:3] for r in rows], 100, 2, 500, 50) if r[0] == 200}


def test_hard_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    alone = spark.createDataFrame([(1, [1.0], 1, "", "", 1), (2, [1.0], 1, "", "", 1)], VECTORS)
    assert negatives.hard_negatives(none).collect() == [] and negatives.hard_negatives(alone).collect() == []


def test_partial_products_discard_early():
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.standard_normal((400, 64)) * np.geomspace(1, 0.01, 64)).astype(np.int64)
    axes = np.linalg.eigh(q.T.astype(float) @ q)[1][:, ::-1]
    a, b = negatives.Rotated(q[:20], axes), negatives.Rotated(q, axes)
    products = q[:20] @ q.T
    low = np.sort(products, axis=1)[:, -6].astype(float)
    i, j, s = negatives.survivors(a, b, slice(0, 400), np.ones((20, 400), bool), low, np.full(20, np.inf))
    assert (s == products[i, j]).all() and {*zip(i, j)} >= {*zip(*np.nonzero(products >= low[:, None]))}
    assert len(i) < 0.05 * products.size


def plain_clusters(rows, k=16, rounds=3, dim=64, scale=64):
    kept = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in first[:k]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    assign = lambda: [min((far(q, c), n) for n, c in enumerate(centroids)) for _, q in kept]
    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [q for (_, q), (_, m) in zip(kept, found) if m == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    by = {n: sum(d for d, m in found if m == n) for _, n in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, n, d, by[n], sum(by.values()), digest[n]) for (i, _), (d, n) in zip(kept, found))


@pytest.mark.parametrize("at_once", [yinyang.AT_ONCE, 37])
def test_clusters(spark, monkeypatch, at_once):
    monkeypatch.setattr(yinyang, "AT_ONCE", at_once)
    rows = odd_vectors()
    got = yinyang.clustered(spark.createDataFrame(rows, VECTORS).repartition(3)).drop("centroid").collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == plain_clusters([r[:2] for r in rows])


def test_clusters_of_few_equal_or_no_vectors(spark):
    same = [(i, [0.5] * 64, 1, "", "", 1) for i in range(30)] + [(40, [2.0**30] * 64, 1, "", "", 1)]
    got = yinyang.clustered(spark.createDataFrame(same, VECTORS)).collect()
    assert len(got) == 30 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}  # ties: the smaller number
    few = yinyang.clustered(spark.createDataFrame(same[:2], VECTORS), k=16).collect()
    assert [(r.cluster, r.distance) for r in few] == [(0, 0), (0, 0)]
    assert yinyang.clustered(spark.createDataFrame([], VECTORS)).collect() == []
    assert yinyang.clustered(spark.createDataFrame(same[30:], VECTORS)).collect() == []


def test_bounds_skip_distances_and_keep_clusters():
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((16, 64)) * 100
    q = np.floor(middle[rng.integers(16, size=3000)] + rng.standard_normal((3000, 64)) * 10).astype(np.int32)
    centroids = q[:16].astype(np.int64)
    of = yinyang.grouped(centroids, 4)
    cluster, upper, lower = yinyang.first_assigned(q, centroids, of)
    measured = []
    for _ in range(6):
        new = np.array([q[cluster == c].sum(axis=0, dtype=np.int64) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(16)])
        drift = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float))
        cluster, upper, lower, n = yinyang.reassigned(q, cluster, upper, lower, new, of, drift)
        centroids = new
        d = ((q[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all() and (upper**2 >= d[np.arange(3000), cluster] * (1 - 1e-9)).all()
        d = d.astype(float)
        d[np.arange(3000), cluster] = np.inf
        assert all((lower[:, g] ** 2 <= d[:, of == g].min(axis=1) * (1 + 1e-9)).all() for g in range(of.max() + 1) if (of == g).any())
        measured.append(n)
    assert measured[-1] < 0.1 * q.shape[0] * 16


def auc(good, bad):
    return np.mean([(np.array(bad) < s).mean() + 0.5 * (np.array(bad) == s).mean() for s in good])


def test_quality_held_out(spark):
    rows = queries.op13_quality_gam(spark, f"{TESTDATA}/sf0.1")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{TESTDATA}/sf0.1/documents.parquet").count()
    seen = rows.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in seen)
    test = [r for r in seen if r.held_out]
    assert len(test) > 1000 and np.mean([r.predicted == r.quality for r in test]) > 0.99
    assert auc([r.score for r in test if r.quality], [r.score for r in test if not r.quality]) > 0.999


def test_quality_of_odd_rows(spark):
    texts = [None, "", " \n", "one", "x" * 100_000, "a line\n" * 5000, "###$$$", "日本語 テスト", "<b>" * 10, "plain words in a plain line. " * 40]
    rows = [(k if k % 4 else None, t, 1, "clash", "clash") for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int, x string, h string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        got = gam.quality(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in gam.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert gam.quality(docs.limit(0), labels).collect() == []
    blank = gam.quality(docs.where("text IS NULL OR trim(text) IN ('', '\n')"), labels).collect()
    assert len({r.score for r in blank}) == 1


def test_tables_learn_curves_and_pairs():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 4))
    curve = (np.abs(x[:, 0] - 0.5) < 0.25).astype(float)  # no line separates it
    both = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)  # neither feature says anything by itself
    alone, paired = gam.fit(x[:3000], curve[:3000], pairs=0), gam.fit(x[:3000], both[:3000])
    assert ((alone.scores(x[3000:]) >= 0.5) == curve[3000:]).mean() > 0.97
    assert (1, 2) in paired.pairs and ((paired.scores(x[3000:]) >= 0.5) == both[3000:]).mean() > 0.95
    assert ((gam.fit(x[:3000], both[:3000], pairs=0).scores(x[3000:]) >= 0.5) == both[3000:]).mean() < 0.65


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x, y = rng.random((500, 3)), rng.integers(0, 2, 500).astype(float)
    model = gam.fit(x, y)
    row = x[7]
    total = model.base + sum(t[(row[k] >= e).sum()] for k, (t, e) in enumerate(zip(model.tables, model.edges)))
    total += sum(t[(row[a] >= model.coarse[a]).sum(), (row[b] >= model.coarse[b]).sum()] for (a, b), t in zip(model.pairs, model.pair_tables))
    assert np.isclose(model.scores(x[7:8])[0], 1 / (1 + np.exp(-total)))
