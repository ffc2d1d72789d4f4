"""DuckDB SQL for the numbered operators' queries, where SQL can express them.

The others (learned scores and rules, fingerprints, repeated strings, token ids) are held against
brute force in the tests.
"""

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_FINITE = "len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0"


def _rounds(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds, one common table after another."""
    hash_ = "sha256('1:' || CAST(vec_id AS VARCHAR))"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY {hash_}) - 1 AS INT) AS c, q AS p FROM v ORDER BY {hash_} LIMIT {k})",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT vec_id, q, min(struct_pack(d := CAST(list_sum([(q[j] - p[j]) * (q[j] - p[j]) FOR j IN range(1, 65)]) AS BIGINT), c := c)) AS best FROM v, c{n} GROUP BY vec_id, q)"
        )
        if n < rounds:
            steps.append(
                f"m{n} AS (SELECT c, list(x ORDER BY j) AS p FROM (SELECT best.c AS c, j, CAST(floor(sum(q[j]) / count(*)) AS BIGINT) AS x FROM a{n}, range(1, 65) AS r(j) GROUP BY best.c, j) GROUP BY c), "
                f"c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.p, c{n}.p) AS p FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c)"
            )
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = best.c"
    )


ORACLES: dict[str, str] = {
    # every place of 200 bytes, as hex digits; a run of places at most 200 apart is a removed stretch
    "op4_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
 r AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM w GROUP BY s HAVING count(*) > 1)),
 g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
 k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g),
 t AS (SELECT doc_id, n, min(i) AS a, max(i) + 200 AS z FROM k GROUP BY ALL),
 l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string([substr(h, 2 * p[1] + 1, 2 * (p[2] - p[1])) FOR p IN list_zip(list_prepend(0, z), list_append(a, len(h) // 2))], '') END)) AS kept_sha256
 FROM d LEFT JOIN l ON l.doc_id = d.doc_id""",
    # of equal payloads the largest page is the response; base32 of the SHA-1, 5 bits a letter
    "op5_warc_segments": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 g AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS of FROM p),
 b AS (SELECT *, array_to_string([lpad(bin(('0x' || c)::INT), 4, '0') FOR c IN string_split(hex, '')], '') AS bits FROM g)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([CAST(substr(bits, 5 * k + j, 1) AS INT) * (1 << (5 - j)) FOR j IN range(1, 6)])::INT, 1) FOR k IN range(0, 32)], '') AS payload_digest,
 CASE WHEN page_id = of THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != of THEN of END AS refers_to FROM b""",
    # the cosine of all pairs of a label, and the least id along links by recursion
    "op9_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
 f AS (SELECT * FROM v WHERE len([c FOR c IN e IF c IS NULL OR NOT isfinite(c)]) = 0 AND len([c FOR c IN e IF c != 0]) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM f a JOIN f b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r AS (SELECT vec_id AS u, vec_id AS root FROM embeddings UNION SELECT l.w, r.root FROM r JOIN l ON l.u = r.u),
 c AS (SELECT u, min(root) AS component_id FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id""",
    # lines that too many different texts of a source share don't count as words of the others
    "op10_quality_rules": f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, {_WORD})] AS ls FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
 t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, range(0, 5) AS x(k) GROUP BY doc_id),
 m AS (SELECT w.doc_id, host, ls, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, {_LOW.format("array_to_string(ws, ' ')")} AS content FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
 b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
 l AS (SELECT doc_id, host, base_failed, content, {_LOW.format(f"array_to_string(regexp_extract_all(x, {_WORD}), ' ')")} AS line, len(regexp_extract_all(x, {_WORD})) AS words FROM (SELECT *, unnest(ls) AS x FROM b)),
 s AS (SELECT host, line, count(DISTINCT content) AS texts, min(doc_id) FILTER (NOT base_failed) AS first FROM l GROUP BY host, line),
 h AS (SELECT host, count(DISTINCT content) AS all_texts FROM b GROUP BY host),
 c AS (SELECT host, line, first FROM s JOIN h USING (host) WHERE texts > 20 AND texts > all_texts * 0.005),
 o AS (SELECT doc_id, sum(words) AS lost FROM l JOIN c USING (host, line) WHERE doc_id IS DISTINCT FROM first GROUP BY doc_id)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND n_words - coalesce(lost, 0) >= 10 AS kept FROM b LEFT JOIN o ON o.doc_id = b.doc_id""",
    # every anchor's scores with all rows
    "op11_hard_negatives": f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([a.q[j] * b.q[j] FOR j IN range(1, len(a.q) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
 QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5""",
    # the rounds written out; sums are far below 2**53, so a quotient of doubles has the exact floor
    "op12_yinyang_clusters": _rounds(),
}
