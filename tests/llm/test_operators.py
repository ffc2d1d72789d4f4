"""The numbered operators against brute force, on small tables and on odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import bpe, chat, doubling, embedding, mixing, neardup, quality, queries, simhash, suffix, toxicity, urlrules, warc
from siftline.llm.oracles import ORACLES
from tests.conftest import TESTDATA

SPACE = " \t\n\v\f\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tx string, row string, host string"


def odd_texts() -> list[str | None]:
    rng = np.random.default_rng(5)
    words = ["ab", "cd", "efg", "häß", "日本", "naïve", "x\u00a0y", "I", "İstanbul"]
    long = " ".join(rng.choice(words, 30_000))
    shared = " ".join(rng.choice(words, 120))
    return [
        None, "", " ", "\n\n", "one", "One", "a b c", "a b c d", "a b c d e", "a b c d", "日本語 テスト", "x" * 5000, long, long + " end", shared,
        "before " + shared + " after", shared + "\n" + shared, "tab\tand\vvt\fff\rcr\nlf", "<|endoftext|> a <|endoftext|>", "it's  they'll \u00a0 x\u2003y",
        "line one here\n" * 30, "emoji 🙂🙂 e\u0301", "###$$$ %%% <b>", "a b c d e f g h i j k l m n o p",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows: nulls everywhere, repeated rows, ties, long texts, clashing column names."""
    texts = odd_texts()
    rows = [(i, t, "xx" if i % 2 else None, None if i % 3 == 0 else "s", i, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(3, texts[3], None, None, None, None, None, None), (None, "a null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def words_of(text: str | None) -> list[str]:
    return [w for w in _split(text or "") if w]


def _split(text: str) -> list[str]:
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return text.split(" ")


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def unite(names, links) -> dict:
    up = {n: n for n in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in names}


def plain_fingerprint(text: str | None) -> int:
    words = words_of(lower(text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_simhash_groups(request, table):
    df = request.getfixturevalue(table).where("doc_id IS NOT NULL").where(F.coalesce(F.length("text"), F.lit(0)) < 60_000)
    rows = df.select("doc_id", "text").collect()
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(plain_fingerprint(r.text))
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if any((x ^ y).bit_count() <= 4 for x in prints[a] for y in prints[b])]
    want = unite(prints, pairs)
    got = simhash.simhash_groups(df).collect()
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == Counter((r.doc_id, plain_fingerprint(r.text), want[r.doc_id]) for r in rows)


def test_vantage_point_trees_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (3, 4, 5, 6)]
    fps = np.unique(np.concatenate((base, np.array(flips, np.uint64))))
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64).tolist())], "fp long, rep long")
    near_ones = [base[:1] ^ np.uint64(int(x)) for x in rng.integers(0, 1 << 20, 500)]  # one large part of many tables
    fps = np.unique(np.concatenate((fps, *near_ones)))
    nodes = spark.createDataFrame([(int(x), i) for i, x in enumerate(fps.view(np.int64).tolist())], "fp long, rep long")
    for bits, homes in ((4, simhash.HOMES), (4, 16), (7, 40), (9, 2000), (0, 2), (1, 100)):
        links = [(r.u, r.v) for r in simhash.near_links(nodes, bits, homes=homes).collect()]
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= bits for a, b in links)
        near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1))
        assert unite(range(len(fps)), links) == unite(range(len(fps)), near.tolist())


def test_near_duplicate_stage(spark, odd):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(400)], 200)) for _ in range(30)]
    near = [" ".join(w if k not in (50, 120) else "changed" for k, w in enumerate(t.split())) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts + near + texts[:5])]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == list(range(30))
    out = neardup.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(None) == 2 and ids.count(7) == 1 and 6 in ids
    empty = neardup.drop_near_duplicates(odd.limit(0))
    assert empty.columns == odd.columns and empty.count() == 0


def plain_groups(rows, width=5, similarity=0.8):
    """{id: smallest id of its group} by comparing all pairs of whole sets of shingles."""
    sets = {}
    for i, t in rows:
        words = words_of(lower(t))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return unite(sets, links)


def near_kept(spark, rows):
    out = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    return sorted(r.doc_id for r in out.collect())


def test_near_duplicates_of_large_families(spark):
    rng = np.random.default_rng(11)
    rows = []
    for length, changed, copies in ((200, 0.008, 150), (200, 0.012, 150), (500, 0.008, 100)):
        words = rng.choice([f"w{k}" for k in range(3000)], length)
        for _ in range(copies):
            rows.append((len(rows), " ".join(np.where(rng.random(length) < changed, f"n{rng.integers(1 << 40)}", words))))
    assert near_kept(spark, rows) == sorted(set(plain_groups(rows).values()))


@pytest.mark.parametrize("kind", ["added", "cut", "moved"])
def test_near_duplicates_with_a_passage(spark, kind):
    """Short and long texts against copies with a passage added, cut or moved to the front, near the threshold."""
    rng = np.random.default_rng(13)
    vocabulary, rows = np.array([f"v{k}" for k in range(2000)]), []
    for length in [12, 30, 60, 200] * 40:
        words = rng.choice(vocabulary, length, p=(w := 1 / np.arange(1, 2001)) / w.sum()).tolist()
        part = max(1, int(length * rng.uniform(0.05, 0.22)))
        other = {"added": words + rng.choice(vocabulary, part).tolist(), "cut": words[part:], "moved": words[part:] + words[:part]}[kind]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    assert near_kept(spark, rows) == sorted(set(plain_groups(rows).values()))


def test_near_duplicates_of_the_documents(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = plain_groups(rows)
    out = sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect())
    assert out == sorted(set(want.values())) and len(out) < len(rows)


def test_near_duplicates_under_one_id(spark):
    rng = np.random.default_rng(17)
    one, other = (" ".join(rng.choice([f"w{k}" for k in range(400)], 100)) for _ in range(2))
    rows = [(1, one), (1, other), (1, other + " end"), (1, one), (2, other)]
    out = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text.startswith(one)) for r in out) == [(1, False), (1, True)]


def test_url_rules(spark, small):
    urls = [
        None, "", "no scheme", "http://", "http://example.com", "http://EXAMPLE.com/en/x?q=1#f", "https://www.example.com/en/", "http://a.www.example.com/en/z",
        "http://myexample.com/en/", "x://b.net/es/1", "x://b.net/es", "x://net/fr/?a", "http://h.org?x=/y", "http://h.org#f://z/", "ftp://ÄB.com/É", "a://b://c/d",
    ]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, urls[5], None, None), (None, urls[4], None, None)], "page_id long, url string, row string, items int")
    labels = spark.createDataFrame([(f"http://bad.example.org/spam/{i}", 1) for i in range(20)] + [(f"http://ok.example.org/fine/{i}", 0) for i in range(40)] + [(None, 1), ("x", None)], "url string, bad int")
    got = urlrules.judge(pages, labels).collect()

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.partition("://")[2]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
        path = rest[len(host) :]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = lower(host)
        fits = [(len(h + p), h + p) for h, p, _ in urlrules.LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None

    want = Counter((i, *plain(u)) for i, u in [*enumerate(urls), (3, urls[5]), (None, urls[4])])
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    verdict = {h + p: v for h, p, v in urlrules.LISTED}
    assert all(r.verdict == verdict[r.rule] for r in got if r.rule)
    bad = urlrules.judge(spark.createDataFrame([(1, "http://bad.example.org/spam/99"), (2, "http://ok.example.org/fine/7")], "page_id long, url string"), labels).collect()
    assert {r.page_id: r.verdict for r in bad} == {1: "block", 2: "allow"}
    assert urlrules.judge(pages.limit(0), labels.limit(0)).count() == 0
    real = spark.read.parquet(f"{small}/pages.parquet")
    rows = queries.op3_url_rules(spark, small).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in rows) == Counter((r.page_id, *plain(r.url)) for r in real.collect())


@pytest.mark.parametrize("piece", [700, suffix.PIECE])
def test_repeated_strings(docs, odd, piece):
    for df, length in ((docs, 200), (odd.where(F.coalesce(F.length("text"), F.lit(0)) < 60_000), 200), (odd, 24)):
        df = df.where(F.coalesce(F.length("text"), F.lit(0)) < 20_000) if length == 24 else df
        rows = df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, *x) for r, x in zip(rows, suffix.brute_force([r.text for r in rows], length)))
        got = suffix.digest(suffix.drop_repeats(df, length=length, piece=piece)).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


@pytest.mark.parametrize("length", [200, 24])
def test_plain_doubling_finds_the_same_places(spark, docs, length):
    """Rank pairs at growing offsets against a table of all strings, and against the sampled ranks."""
    rows = [(k, r.text) for k, r in enumerate(docs.orderBy("doc_id").limit(60).collect())]
    rows += [(1000, None), (1001, "ab" * 200), (1002, "short"), (1003, "é" * 150), (1004, rows[0][1])]
    seen = Counter(t.encode()[i : i + length] for _, t in rows if t for i in range(len(t.encode()) - length + 1))
    want = {(k, i) for k, t in rows if t for i in range(len(t.encode()) - length + 1) if seen[t.encode()[i : i + length]] > 1}
    frame = spark.createDataFrame(rows, "row long, text string")
    got = {(r.row, r.pos) for r in doubling.doubled_windows(frame, length).collect()}
    assert got == want and len(want) > 200
    spans = {r.id: r.spans for r in suffix.repeated_spans(frame, "row", length=length).collect()} if length == 200 else {}
    assert all(any(s.start <= i and i + length <= s.end for s in spans[k]) for k, i in want if spans)


def test_repeats_cleaned(odd):
    out = suffix.cleaned(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where("doc_id = 15").first().text == "before  after"
    assert suffix.cleaned(odd.limit(0)).count() == 0


@pytest.mark.parametrize("segment,least", [(400, 0), (warc.SEGMENT, 5)])
def test_warc_round_trip(spark, small, segment, least):
    html = [None, "", "<p>x</p>", "<p>x</p>", "é" * 30_000, "é" * 30_000, "0\r\n\r\nWARC/1.1\r\n", "y" * 9_000, "\r\n\r\n"]
    odd = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y" if i % 2 else None, h, "c") for i, h in enumerate(html)] + [(None, None, "<p>x</p>", None)], "page_id long, url string, html string, row string")
    for pages in (odd, spark.read.parquet(f"{small}/pages.parquet"), odd.limit(0)):
        rows = pages.collect()
        data = [(r.page_id, (r.html or "").encode()) for r in rows]
        best = {}
        for i, d in data:
            if i is not None:
                best[d] = max(best.get(d, i), i)
        want = Counter()
        for i, d in data:
            again = len(d) >= least and best.get(d, i) != i
            want[i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if again else "response", best[d] if again else None] += 1
        got = warc.archive_round_trip(pages, segment=segment, least=least).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_reads_what_is_cut_short_as_null(spark, tmp_path):
    page = list(warc.records_of(1, 1, "u", b"z" * 3000, None, 1000))
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in (page[0], page[2], page[3])))
    (tmp_path / "b.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in warc.records_of(2, 2, "v", b"q" * 3000, None, 1000)))
    got = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got[1] is None and bytes(got[2]) == b"q" * 3000


def test_toxicity_held_out(spark, odd):
    data = queries.op6_toxicity_grammar(spark, f"{TESTDATA}/sf0.1")
    labels = spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet").select(F.col("doc_id").alias("i"), "toxic").dropna()
    rows = data.join(labels, F.col("doc_id") == F.col("i")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == r.toxic for r in held) / len(held)
    base = max(Counter(r.toxic for r in held).values()) / len(held)
    assert right > 0.95 and right >= base
    bad = [r for r in held if r.toxic]
    assert sum(r.predicted for r in bad) / len(bad) > 0.8
    none = labels.select(F.col("i").alias("doc_id"), "toxic").limit(0)
    out = toxicity.toxicity(odd, none)
    assert out.count() == odd.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.toxicity(odd.limit(0), none).count() == 0


def test_grammar_marks_clauses():
    symbols = toxicity.Symbols(frozenset("idiot clown trash stupid fool".split()), frozenset())
    kind = lambda pattern, flags=0: pattern * 4 + flags
    t = toxicity
    for text, want in {
        "You are such an idiot!": [kind(t.INSULT_DIRECT)], "a clown came": [kind(t.INSULT_MENTIONED)], "what a piece of trash": [kind(t.INSULT_SAID)],
        "you are not stupid": [kind(t.INSULT_DIRECT, t.NEGATED)], "She said he is a fool.": [kind(t.INSULT_DIRECT, t.REPORTED)],
        "I will kill it": [kind(t.HARM_MEANT)], "kill you": [kind(t.HARM_AIMED)], "you will die": [kind(t.HARM_MEANT)], "kill the process. they die young": [],
        "we won't beat them": [kind(t.HARM_AIMED, t.NEGATED)], "Watch your back; now shut up": [kind(t.THREAT_SAID), kind(t.INSULT_SAID)], "watch your step, shut the door, up": [],
        "clown. clown. clown. clown. clown": [kind(t.INSULT_MENTIONED)] * 5, "": [], None: [],
    }.items():
        counts = t.clause_counts(text, symbols)
        assert [k for k, n in enumerate(counts) for _ in range(n)] == sorted(want), text


def test_grammar_beats_its_words(spark):
    """Texts whose words alone don't tell: the same insults and acts, said to someone or not."""
    rng = np.random.default_rng(4)
    bad = ["you are a complete {i}", "you {i}", "she is a {i} and a {j}", "what a piece of {i}", "i will {h} you", "we are going to {h} them", "{h} him now", "you will die", "shut up and go to hell"]
    fine = ["she said that he is a {i}", "you are not a {i}", "they are never {i}", "he wrote that they will {h} him", "we must not {h} them", "they {h} the process", "the reports say you will die"]
    fill = lambda t: t.format(i=rng.choice(["idiot", "fool", "clown", "jerk"]), j=rng.choice(["loser", "moron"]), h=rng.choice(["kill", "hurt", "beat"]))
    rest = [" ".join(rng.choice([f"w{k}" for k in range(300)], 12)) for _ in range(600)]
    rows = [(k, f"{rest[k]}. {fill(str(rng.choice(bad if k % 2 else fine)))}. {rest[-k]}", k % 2) for k in range(600)]
    known = ("idiot", "fool", "clown", "jerk", "loser", "moron")  # as frequent in texts of either kind, so no labels teach them
    out = toxicity.toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), insults=known).collect()
    held = [r for r in out if r.held_out]
    words = {w for k in (toxicity.HARM, toxicity.DIE) for w in toxicity.WORDS[k].split()} | set(known)
    by_words = sum(bool(words & set(rows[r.doc_id][1].split())) == rows[r.doc_id][2] for r in held)
    by_grammar = sum(r.predicted == rows[r.doc_id][2] for r in held)
    assert len(held) > 80 and by_grammar > 0.95 * len(held) > 0.7 * len(held) > by_words


def test_bpe_splits_as_the_library(monkeypatch):
    """Letters newer than the library's, white space, NULs and specials, with caches that turn over."""
    import random
    import struct

    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "PAIRS", 200)
    library, code, dice = Tokenizer.from_file(queries.vocabulary()), bpe.Coder(queries.vocabulary()), random.Random(7)
    parts = [" ", "  ", "\n", "\0", " \0", "\t", "\u3000", "\x85", "\u088f", "\u208f", "'s", "\u00e9", "\u65e5", "<|endoftext|>", "the", " The", "tion", "1234", "...", "\u200b"]
    for _ in range(150):
        texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(25))) for _ in range(10)]
        for text, packed in zip(texts, code.encode(texts)):
            want = library.encode(text, add_special_tokens=False).ids
            assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want, repr(text)
            assert code.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_bpe(spark, docs, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    tok = Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    for df in (docs, odd, odd.limit(0)):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            text = tok.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
        got = bpe.digest(bpe.decode(bpe.encode(df, path), path)).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_chat(spark, small):
    real = chat.with_probe(spark.read.parquet(f"{small}/conversations.parquet"))
    rows = [(1, 0, "system", "be [INST] kind \\ </s>"), (1, 1, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "a b " * 3000), (2, 5, None, "x"), (2, 5, "assistant", "\\\\[/TURN]"), (2, 5, "assistant", "\\\\[/TURN]"), (3, None, "user", "q")]
    rows += [(4, t, ("user", "assistant")[t % 2], "w " * (t % 90)) for t in range(3000)]
    odd = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, pos string, span int")
    for df in (real, odd, odd.limit(0)):
        each = defaultdict(list)
        for r in df.collect():
            each[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
        want = {c: chat.brute_force([x[2:] for x in sorted(v)]) for c, v in each.items()}
        got = chat.read_back(chat.windows(df)).collect()
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def test_chat_windows_keep_the_budget(spark):
    df = spark.createDataFrame([(1, t, ("system" if t == 0 else "user" if t % 2 else "assistant"), "w " * 40) for t in range(200)], "conv_id long, turn long, role string, text string")
    rows = chat.windows(df).collect()
    assert len(rows) > 10
    for r in rows:
        turns = chat.parse_turns(r.formatted)
        assert sum(len(t.split()) + 4 for _, t in turns) <= chat.BUDGET
        assert turns[0][0] == "system" and (r.repeats > 1 or r.first_pos == 0)


@pytest.mark.parametrize("budget,history,block", [(chat.BUDGET, chat.HISTORY, chat.BLOCK), (60, 20, 7), (25, 0, 3)])
def test_chat_spans_end_only_where_a_turn_does_not_fit(spark, monkeypatch, budget, history, block):
    """Spans of every conversation as one after another cuts them, however its turns are dealt to blocks."""
    monkeypatch.setattr(chat, "BLOCK", block)
    rng, rows = np.random.default_rng(budget), []
    for conv in range(12):
        for t in range(int(rng.choice([1, 2, 30, 400]))):
            rows.append((conv, t, "system" if t == 0 and conv % 3 else ("user", "assistant")[t % 2], "w " * int(rng.choice([0, 1, 5, 20, 90], p=[0.2, 0.3, 0.3, 0.15, 0.05]))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.window): r for r in chat.windows(df, budget=budget, history=history).collect()}
    size = lambda text: len((text.strip() or "x").split()) + 4
    want, lead = defaultdict(list), {c: size(t) for c, k, r, t in rows if r == "system"}
    for conv, t, role, text in rows:
        room = max(1, budget - lead.get(conv, 0) - history)
        now = max((k for k in want if k[0] == conv), default=None)
        if now is None or sum(want[now]) + size(text) > room:
            now = (conv, t)
        want[now].append(size(text))
    assert {k: len(chat.parse_turns(r.formatted)) - r.repeats for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    for (conv, first), r in got.items():
        whole = sum(size(t) for _, t in chat.parse_turns(r.formatted))
        assert whole <= max(budget, lead.get(conv, 0) * (first > 0) + sum(want[conv, first])) and (len(want[conv, first]) == 1 or whole <= budget)


def plain_links(rows, threshold=0.98):
    out = []
    good = [(i, r) for i, r in enumerate(rows) if r.label is not None and r.vec_id is not None and r.embedding is not None and len(r.embedding) and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)]
    for (i, a), (j, b) in itertools.combinations(good, 2):
        if a.label == b.label and len(a.embedding) == len(b.embedding):
            x, y = np.array(a.embedding, float), np.array(b.embedding, float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                out.append((i, j))
    return out


@pytest.mark.parametrize("homes,visitors,leaf", [(embedding.HOMES, embedding.VISITORS, embedding.LEAF), (16, 24, 8)])
def test_embedding_groups(spark, small, monkeypatch, homes, visitors, leaf):
    monkeypatch.setattr(embedding, "LEAF", leaf)
    monkeypatch.setattr(embedding, "HOMES", homes)
    monkeypatch.setattr(embedding, "VISITORS", visitors)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(i, (base + rng.standard_normal(32) * s).tolist(), 1) for i, s in enumerate([0.05] * 40 + [0.2] * 40)]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 32, 1), (103, [float("nan")] + [1.0] * 31, 1), (104, [None] + [1.0] * 31, 1), (105, [float("inf")] * 32, 1), (106, base.tolist(), None), (107, base.tolist()[:8], 1), (108, rows[0][1], 1), (108, rows[0][1], 1), (109, (2 * base).tolist(), 2), (110, [1.0], 3), (111, [2.0], 3)]
    odd = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, nid string, vec double")
    for df in (odd, spark.read.parquet(f"{small}/embeddings.parquet"), odd.limit(0)):
        rows = df.select("vec_id", "embedding", "label").collect()
        links = plain_links(rows)
        n = Counter(x for link in links for x in link)
        place = unite(range(len(rows)), links)
        least = {}
        for i, r in enumerate(rows):
            least[place[i]] = min(least.get(place[i], r.vec_id), r.vec_id)
        got = embedding.embedding_groups(df).collect()
        want = Counter((r.vec_id, n[i], least[place[i]], least[place[i]] == r.vec_id) for i, r in enumerate(rows))
        assert Counter(tuple(r) for r in got) == want


def plain_counts(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(wins)
    hit = {i + k for i, w in enumerate(wins) if seen[w] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n


def test_quality(docs, odd, spark):
    for df in (docs, odd, odd.limit(0)):
        rows = df.select("doc_id", "text").collect()
        got = quality.digest(quality.verdicts(df)).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r.doc_id, *plain_counts(r.text)) for r in rows)
        assert not any(r.kept and r.base_failed for r in got)


def test_quality_cuts_lines_of_many_documents(spark, odd):
    menu = "Home About Contact and the rest of the menu that each page has"
    body = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{menu}\n{body(i, 30)}", "h") for i in range(60)] + [(100 + i, f"{menu}\n{body(900 + i, 3)}", "h") for i in range(5)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    assert sorted(out) == list(range(60))
    assert out[0].text.startswith(menu) and all(menu not in out[i].text and out[i].n_chars == len(out[i].text) for i in range(1, 60))
    cut = quality.apply_rules(odd)
    assert cut.columns == odd.columns and cut.where("length(text) = 0").count() == 0
    assert quality.apply_rules(odd.limit(0)).count() == 0


def test_mixing_meets_its_targets(spark, docs, odd, small):
    labels = mixing.label_domains(spark.read.parquet(f"{small}/labels.parquet"))
    rows = mixing.mixing_rates(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    total = sum(r.n_tokens for r in rows)
    got = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS]) / total
    want = np.array(list(mixing.TARGETS.values()))
    before = np.array([sum(r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.TARGETS]) / total
    assert np.abs(got - want).max() < 0.01 and np.linalg.norm(got - want) <= np.linalg.norm(before - want)
    out = mixing.mixing_rates(odd, labels.limit(0))
    assert out.count() == odd.count() and out.where("rate < 0 OR rate IS NULL").count() == 0
    assert mixing.mixing_rates(odd.limit(0), labels).count() == 0
    again = mixing.mixed(odd, labels)
    assert again.columns == odd.columns


def test_least_squares_with_targets_out_of_reach(spark):
    rows = [(10, [1.0, 0.0])] * 4
    frame = spark.createDataFrame(rows, T.StructType([T.StructField("_tokens", T.LongType()), T.StructField("_p", T.ArrayType(T.DoubleType()))]))
    fit = mixing.fit_rates(frame, [0.25, 0.75])
    assert np.allclose(mixing.replay(np.array([[1.0, 0.0]]), fit.steps), 0.25, atol=1e-3)
    assert fit.settled and np.isclose(fit.residual, 0.75, atol=1e-3) and not mixing.fit_rates(frame, [0.25, 0.75], rounds=0).settled
    assert mixing.fit_rates(frame.limit(0), [0.5, 0.5]).steps == []


def nonnegative_least_squares(a, b):
    """min |a x - b| over x >= 0 by an active set (dense, for tests)."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(10 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        if free.all() or slope[~free].max() < 1e-9 * np.abs(a).max() * max(1.0, np.abs(b).max()):
            break
        free[np.flatnonzero(~free)[slope[~free].argmax()]] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (z[free] > 0).all():
                x = z
                break
            low = free & (z <= 0)
            step = (x[low] / (x[low] - z[low])).min()
            x = x + step * (z - x)
            free &= x > 1e-12
    return x


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"good": 0.05, "low": 0.15, "toxic": 0.8}, {"good": 0.0, "low": 1.0, "toxic": 0.0}])
def test_rates_are_as_near_as_dense_least_squares(spark, docs, small, targets):
    labels = mixing.label_domains(spark.read.parquet(f"{small}/labels.parquet"))
    rows = mixing.mixing_rates(docs, labels, targets).collect()
    a = np.array([[r.n_tokens * r[f"p_{d}"] for r in rows] for d in targets])
    whole = a.sum()
    goal = whole * np.array(list(targets.values())) / sum(targets.values())
    best = np.linalg.norm(a @ nonnegative_least_squares(a, goal) - goal) / whole
    mine = np.linalg.norm(a @ np.array([r.rate for r in rows]) - goal) / whole
    assert np.isclose(mine, rows[0].residual, atol=1e-9)
    # rates that meet the last targets are huge ones of the few purest rows: rounds end before, and say so
    assert (mine <= best + 1e-4) if rows[0].settled else (targets["low"] == 1 and mine < 0.02)


def test_mixing_without_labels_or_documents(docs, odd):
    labels = docs.select("doc_id", F.lit("good").alias("domain"))
    for labelled in (labels.limit(0), labels):
        out = mixing.mixing_rates(odd, labelled)
        assert out.count() == odd.count()
        assert out.where("p_good IS NULL OR rate < 0").count() == 0
    assert mixing.mixing_rates(odd.limit(0), labels).count() == 0
    assert mixing.mixed(odd.limit(0), labels).columns == odd.columns and mixing.mixed(odd.limit(0), labels).count() == 0


def test_columns_of_any_name_stay(spark):
    """Users' columns named as the stages name theirs come back as they were."""
    text = "\n".join(f"word{k} more words in line {k} of this text" for k in range(40))
    mine = ["_tx", "_id", "_gone", "_spans", "_gid", "id", "k1", "k2", "tx", "row", "kept", "gone", "spans", "text_", "host", "label", "_row", "_words"]
    rows = [(k, text.replace("word", f"w{k // 2}x"), "s", *[f"{c}{k}" for c in mine]) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in mine))
    labels = spark.createDataFrame([(0, "good"), (1, "low"), (2, "toxic")], "doc_id long, domain string")
    for stage in (quality.apply_rules, neardup.drop_near_duplicates, suffix.cleaned, lambda d: mixing.mixed(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in mine)


def test_line_hash_is_that_of_the_words(spark):
    lines = ["", " ", "a", "A  b\tC\r", "\x0b x \x0c y", "ÄÖ Üx\u00a0y", "word " * 40, "日本 語", *("x" * n for n in range(1, 70, 7))]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", quality.line_hash(F.col("x")).alias("h")).collect()
    assert all(r.h == quality.normal_hash(r.x.encode().split()) for r in got)


def test_trees_of_parts_keep_close_fingerprints_together():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    fps = np.unique(np.concatenate((base, base ^ np.uint64(1 << 40 | 1 << 3 | 1 << 20 | 1 << 60))))
    row, shard, home = simhash.route(fps, np.full(len(fps), 7, np.uint64), np.full(len(fps), 12), 4)
    lives, seen = dict(zip(row[home].tolist(), shard[home].tolist())), set(zip(row.tolist(), shard.tolist()))
    assert len(lives) == len(fps) and len(set(lives.values())) > 100
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert len(near) > 1500 and all((a, lives[b]) in seen for a, b in near.tolist())


@pytest.mark.parametrize("bits", [0, 1, 4, 9])
def test_tables_cover_all_close_pairs(bits):
    """Whichever bits differ, two blocks agree; the number of copies depends on the bits alone."""
    rng, masks = np.random.default_rng(bits), simhash.tables_of(bits)
    assert len(masks) == (bits + 2) * (bits + 1) // 2
    for _ in range(2000):
        gap = sum(1 << int(k) for k in rng.choice(64, bits, replace=False))
        assert any(not gap & m for m in masks)


def test_vectors_of_any_length_link(spark):
    rows = [(k, "a", [x * c for x in (1.0, 2.0, 3.0)]) for k, c in enumerate((1e-310, 1e-200, 1.0, 1e200, 1e307, -1.0))]
    rows += [(10, "a", [float("inf"), 1.0, 1.0]), (11, "a", [0.0, 0.0, 0.0]), (12, "a", [float("nan"), 1.0, 1.0]), (13, "a", [None, 1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.embedding_groups(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 5: (0, 5), **{k: (0, k) for k in (10, 11, 12, 13)}}


def test_damaged_archives_are_told(spark, tmp_path):
    records = [b"".join((r, b"\r\n\r\n")) for k in range(3) for r in warc.records_of(k, k, "u", b"payload %d" % k, None, 1000)]
    (tmp_path / "good.warc").write_bytes(b"".join(records))
    (tmp_path / "cut.warc").write_bytes(records[0] + records[1][:-30])
    (tmp_path / "noise.warc").write_bytes(b"no record\r\n")
    (tmp_path / "cut.warc.gz").write_bytes(__import__("gzip").compress(b"".join(records))[:-40])
    (tmp_path / "framing.warc").write_bytes(records[2].replace(b"\r\n9\r\n", b"\r\nz\r\n"))
    got = warc.read_archives(spark, str(tmp_path)).collect()
    kinds = Counter(r.record_type for r in got)
    assert kinds["damaged"] == 3 and all(r.record_id is None for r in got if r.record_type == "damaged")
    assert sorted(r.page_id for r in got if r.payload) >= [0, 0, 1, 2] and [r.page_id for r in got if r.record_type == "response" and r.payload is None] == [2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_their_sql(spark, name):
    small = f"{TESTDATA}/sf0.01"
    got = queries.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    with duckdb.connect() as db:
        for t in ("documents", "embeddings", "pages", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
        frame = db.execute(ORACLES[name])
        names = [c[0] for c in frame.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        want = Counter(tuple(r[k] for k in order) for r in frame.fetchall())
    assert Counter(map(tuple, got.select(*columns).collect())) == want


def test_cells_shrink_as_vectors_grow_in_number():
    """Every close pair meets in a cell where one of them lives, and pairs per square of the number fall."""
    rng, rates = np.random.default_rng(8), []
    for n in (2_000, 8_000, 32_000):
        u = embedding._rotated(rng.standard_normal((n, 64)))
        depth = max(0, math.ceil(math.log2(n / embedding.LEAF)))
        radius, pairs = math.sqrt(0.04 * 8 / 64 + embedding.SLACK), 0
        for a in range(0, 64, 8):
            tree = embedding.build_tree(u[: 1 << 14, a : a + 8], depth)
            row, cell, home = embedding.route(u[:, a : a + 8], tree, np.full(n, depth), radius)
            assert home.sum() == n and len(np.unique(row[home])) == n
            pairs += int(np.bincount(cell[home], minlength=cell.max() + 1) @ np.bincount(cell))
        rates.append(pairs / n**2)
    assert rates[0] > 1.5 * rates[1] > 1.5**2 * rates[2]
    x = embedding._rotated(np.repeat(rng.standard_normal((200, 64)), 3, axis=0) + 0.05 * rng.standard_normal((600, 64)))[:, :8]
    tree = embedding.build_tree(x, 6)
    row, cell, home = embedding.route(x, tree, np.full(600, 6), 0.1)
    lives, visits = dict(zip(row[home], cell[home])), set(zip(row, cell))
    i, j = np.nonzero(((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.01)
    assert len(i) > 600 and all((a, lives[b]) in visits for a, b in zip(i, j))


def test_reading_goes_on_after_damage(spark, tmp_path):
    """Of a file of members one that is damaged loses its record alone; a plain file goes on at the next record."""
    pages = spark.createDataFrame([(k, f"u{k}", f"page {k} " * 50) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    (part,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    raw = bytearray(part.read_bytes())
    starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", bytes(raw))]
    assert len(starts) == 60 and gzip.decompress(bytes(raw)).count(b"WARC/1.1") == 60
    for k in (0, 7, 8, 30):
        raw[starts[k] + 60] ^= 0xFF
    plain = [b"".join((r, b"\r\n\r\n")) for k in range(100, 105) for r in warc.records_of(k, k, "u", b"payload %d" % k, None, 1000)]
    plain[2] = plain[2].replace(b"Content-Length: ", b"Content-Length: x")
    for name, content in {"a.warc.gz": bytes(raw), "b.warc.gz": bytes(raw[: starts[59] + 40]), "c.warc": b"".join(plain)}.items():
        (tmp_path / name).write_bytes(content)
        got = warc.read_archives(spark, f"file://{tmp_path}/{name}").collect()
        ids, damaged = sorted(r.page_id for r in got if r.page_id is not None), sum(r.record_type == "damaged" for r in got)
        if name == "c.warc":
            assert ids == [100, 101, 103, 104] and damaged == 1
        else:
            assert len(ids) == (56 if name[0] == "a" else 55) and damaged == (3 if name[0] == "a" else 4)  # two neighbours are one stretch
            assert all(r.payload_digest == r.stated_digest for r in got if r.page_id is not None)


def test_segments_of_one_number(spark, tmp_path):
    first, second = list(warc.records_of(1, 1, "u", b"z" * 3000, None, 1000)), list(warc.records_of(2, 2, "v", b"y" * 3000, None, 1000))
    odd = second[1].replace(b"yyyy", b"xxxx", 1)
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in (*first, first[1], *second, odd)))
    got = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert bytes(got[1]) == b"z" * 3000 and got[2] is None
