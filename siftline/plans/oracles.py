"""DuckDB SQL that gives the same rows as the queries, from the tables' own columns."""

from __future__ import annotations

_E = """WITH e AS (SELECT event_id AS line_no, CAST(ts AS DATE) AS log_date, strftime(ts, '%H:%M:%S') AS stamp, 'host' || (user_id % 20) AS host, event_type AS program,
 strftime(ts, '%H:') || lpad(CAST(minute(ts) // 10 * 10 AS VARCHAR), 2, '0') AS bucket, lpad(CAST(hour(ts) // 6 * 6 AS VARCHAR), 2, '0') || ':00' AS quarter, props,
 event_type || '[' || event_id || ']: ' || props AS rest, strftime(ts, '%b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S ') AS head,
 strftime(ts, '%b ') || day(ts) || strftime(ts, ' %H:%M:%S ') AS short_head FROM events),
 l AS (SELECT *, head || host || ' ' || rest AS raw, program || ': ' || props AS key, regexp_replace(props, '[0-9]+', '<n>', 'g') AS template,
 CASE WHEN host LIKE 'host1%' AND program = 'error' THEN 1 WHEN regexp_matches(props, '"k": 8[0-9]') THEN 2 WHEN length(host) = 5 AND program LIKE 's%' THEN 3 END AS rule_id,
 CASE WHEN program = 'error' THEN 'an error' WHEN regexp_matches(props, '"k": [0-4][0-9]\\}') THEN 'a low k' END AS said FROM e),
 n AS (SELECT *, CASE WHEN said IS NULL THEN raw ELSE short_head || host || ' ' || said END AS made, coalesce(said, key) AS made_key FROM l),
 t AS (SELECT host, program, count(*) AS n FROM e GROUP BY ALL), td AS (SELECT host, program, log_date, count(*) AS n FROM e GROUP BY ALL)"""
_Z = "CASE WHEN mad > 0 THEN 0.6745 * (x - med) / mad WHEN ad > 0 THEN (x - med) / (1.253 * ad) ELSE 0 END"
_PEER = f"""{_E}, m AS (SELECT program, median(n) AS med, count(*) AS peers FROM t GROUP BY ALL), o AS (SELECT t.*, n AS x, med, peers, abs(n - med) AS off FROM t JOIN m USING (program)),
 q AS (SELECT program, median(off) AS mad, avg(off) AS ad FROM o GROUP BY ALL), peer AS (SELECT host, program, n, peers, med, {_Z} AS score FROM o JOIN q USING (program)),
 pa AS (SELECT * FROM peer WHERE peers >= 5 AND n >= 10 AND score > 0)"""


def _history(name: str, bucket: str) -> str:
    more = f", {bucket} AS b" if bucket else ", '' AS b"
    return f"""{name}_d AS (SELECT host, program{more}, log_date, count(*) AS n FROM e GROUP BY ALL),
 {name}_h AS (SELECT * FROM {name}_d WHERE log_date >= DATE '2024-01-16' AND log_date < DATE '2024-01-30'),
 {name}_m AS (SELECT host, program, b, count(*) AS days_seen, median(n) AS med FROM {name}_h GROUP BY ALL HAVING count(*) >= 7),
 {name}_q AS (SELECT host, program, b, days_seen, med, median(abs(n - med)) AS mad, avg(abs(n - med)) AS ad FROM {name}_h JOIN {name}_m USING (host, program, b) GROUP BY ALL),
 {name}_t AS (SELECT host, program, b, n FROM {name}_d WHERE log_date = DATE '2024-01-30')"""


_BASE = f"""{_PEER}, {_history("bl", "")}, bs AS (SELECT host, program, today, days_seen, med, {_Z} AS score FROM (SELECT *, coalesce(n, 0) AS today, coalesce(n, 0) AS x FROM bl_q LEFT JOIN bl_t USING (host, program, b))),
 ba AS (SELECT *, CASE WHEN today = 0 AND med >= 1 THEN 'silent' WHEN score > 0 THEN 'louder' ELSE 'quieter' END AS direction FROM bs WHERE (today = 0 AND med >= 1) OR (med >= 1 AND abs(score) >= 2))"""
_TEMP = f"""{_BASE}, {_history("tp", "quarter")}, ts AS (SELECT host, program, b AS bucket, n AS today, days_seen, med, {_Z} AS score FROM (SELECT *, n AS x FROM tp_q JOIN tp_t USING (host, program, b))),
 ta AS (SELECT * FROM ts WHERE today >= 1 AND score >= 2)"""
_F = """WITH f AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS log_date, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'peer' ELSE 'issue' END AS kind,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity, 'Order ' || o_orderkey AS title, 'svc' || (o_custkey % 5) AS service FROM orders),
 h AS (SELECT l_orderkey AS finding_id, 'host' || (l_suppkey % 3) AS host, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
 v AS (SELECT l_orderkey AS finding_id, l_returnflag AS flag FROM lineitem WHERE l_returnflag IN ('A', 'R')
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) = 1),
 r AS (SELECT run_id, log_date, CASE WHEN run_id % 3 != 0 THEN count(*) * 100 END AS raw_lines, CASE WHEN run_id % 3 != 0 THEN count(*) END AS filtered_lines FROM f GROUP BY run_id, log_date)"""
_P = "log_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07'"
_G = f"""{_F}, hl AS (SELECT finding_id, string_agg(host, ',' ORDER BY host) AS hosts, count(*) AS n_hosts FROM h GROUP BY ALL),
 w AS (SELECT f.*, coalesce(hosts, '') AS hosts, coalesce(n_hosts, 0) AS n_hosts, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM f LEFT JOIN hl ON id = finding_id WHERE kind = 'issue' AND {_P}),
 g AS (SELECT service, hosts, n_hosts, count(DISTINCT log_date) AS n_days, min(rank) AS rank, arg_min(severity, rank) AS severity, arg_max(id, (log_date, id)) AS latest_id FROM w GROUP BY service, hosts, n_hosts)"""
_D = f"""{_F}, c AS (SELECT CAST(CAST(ts AS DATE) - 9438 AS DATE) AS day, count(*) AS counted FROM events GROUP BY ALL), s AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '1998-03-01', DATE '1998-03-31', INTERVAL 1 DAY)),
 days AS (SELECT day, coalesce(raw_lines, counted) AS volume, raw_lines IS NULL AND counted IS NOT NULL AS approximate, filtered_lines, coalesce(nf, 0) AS n_findings
 FROM s LEFT JOIN r ON r.log_date = day LEFT JOIN c USING (day) LEFT JOIN (SELECT log_date, count(*) AS nf FROM f GROUP BY ALL) k ON k.log_date = day)"""

def _masked() -> str:
    """The mask as nested calls; ``\\b`` knows ASCII words only here, and a name has a letter in one of its labels."""
    label, blank = "[0-9A-Za-z_-]+", "[0-9_-]"
    h, word = "[0-9a-fA-F]{1,4}", f"{blank}*[A-Za-z][0-9A-Za-z_-]*"
    host = "'host' || (doc_id % 20)"
    steps = [
        (r"'[0-9A-Za-z_.+%-]+@[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]+)+'", "<email>"), (host, "<host>"),
        (r"'\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b'", "<ip>"), (rf"'\b(?:{h}:){{5,7}}{h}\b|(?:{h}(?::{h}){{0,6}})?::(?:{h}(?::{h}){{0,6}})?'", "<ip6>"),
        (rf"'\b(?:{word}(?:\.{label}){{2,}}|{blank}+\.{word}(?:\.{label})+|{blank}+(?:\.{blank}+)+\.{word}(?:\.{label})*)\b'", "<fqdn>"),
        (r"'\b[0-9a-fA-F-]{16,}\b'", "<hex>"), (r"'(?i)\b(user[= ])([^\t\n\f\r ]+)'", r"\1<user>"),
        (r"'\bfor (invalid user )?([^\t\n\f\r ]+) from\b'", r"for \1<user> from"),
    ]
    out = r"translate(text, chr(13) || chr(10), '  ')"
    for pattern, token in steps:
        out = f"regexp_replace({out}, {pattern}, '{token}', 'g')"
    return f"array_to_string([CASE WHEN regexp_full_match(p, '[0-9]+') THEN '<n>' ELSE p END FOR p IN regexp_extract_all({out}, '<[a-z0-9]+>|[0-9]+|[^<0-9]+|<')], '')"


_MASK = _masked()


ORACLES: dict[str, str] = {
    "parse_lines": f"{_E} SELECT line_no, host, program, bucket, stamp FROM e",
    "window_counts": f"{_E} SELECT host, program, bucket, count(*) AS n FROM e GROUP BY ALL",
    "pair_totals": f"{_E} SELECT * FROM t",
    "host_programs": f"{_E} SELECT host, string_agg(program, ',' ORDER BY program) AS programs FROM t GROUP BY ALL",
    "first_example": f"{_E} SELECT host, program, arg_min(raw, line_no) AS example FROM l GROUP BY ALL",
    "peer_scores": f"{_PEER} SELECT host, program, n, peers, round(med, 6) AS median, round(score, 6) AS score FROM peer",
    "peer_anomalies": f"{_PEER} SELECT host, program, n, peers, round(score, 6) AS score FROM pa",
    "baseline_scores": f"{_BASE} SELECT host, program, today, days_seen, round(med, 6) AS median, round(score, 6) AS score FROM bs",
    "baseline_anomalies": f"{_BASE} SELECT host, program, today, direction, round(score, 6) AS score FROM ba",
    "temporal_scores": f"{_TEMP} SELECT host, program, bucket, today, days_seen, round(med, 6) AS median, round(score, 6) AS score FROM ts",
    "temporal_anomalies": f"{_TEMP} SELECT host, program, bucket, today, round(score, 6) AS score FROM ta",
    "combined_anomalies": f"""{_TEMP}, u AS (SELECT host, program, 'peer' AS kind, 0 AS o, '' AS bucket, score FROM pa UNION ALL SELECT host, program, 'baseline', 1, '', score FROM ba UNION ALL SELECT host, program, 'temporal', 2, bucket, score FROM ta)
 SELECT host, program, kind, bucket, round(score, 6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY host, program ORDER BY abs(score) DESC, o, score DESC, bucket) = 1""",
    "trailing_baselines": f"{_E} SELECT a.host, a.program, a.log_date, a.n, count(b.n) AS days_seen, round(median(b.n), 6) AS median FROM td a LEFT JOIN td b ON a.host = b.host AND a.program = b.program AND b.log_date BETWEEN a.log_date - 14 AND a.log_date - 1 GROUP BY ALL",
    "known_filter": f"{_E} SELECT line_no, raw FROM l WHERE rule_id IS NULL",
    "known_hits": f"{_E} SELECT CAST(rule_id AS BIGINT) AS rule_id, count(*) AS lines, count(DISTINCT host) AS hosts FROM l WHERE rule_id IS NOT NULL GROUP BY ALL",
    "hit_messages": f"{_E} SELECT key AS message, count(*) AS lines FROM l WHERE rule_id = 2 GROUP BY ALL",
    "mute_anomalies": f"{_PEER} SELECT host, program, n, round(score, 6) AS score FROM pa WHERE NOT (host LIKE 'host1%' AND program = 'error') AND NOT (length(host) = 5 AND program LIKE 's%')",
    "normalise_lines": f"{_E} SELECT line_no, made AS raw FROM n",
    "cap_repeats": f"{_E} SELECT line_no, raw FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY line_no) <= 3",
    "message_spread": f"{_E} SELECT key, count(DISTINCT host) AS hosts FROM l GROUP BY ALL",
    "log_filter": f"{_E} SELECT line_no, made AS raw FROM n WHERE rule_id IS NULL QUALIFY row_number() OVER (PARTITION BY made_key ORDER BY line_no) <= 3",
    "collapse_repeats": f"""{_E} SELECT min(line_no) AS line_no, CASE WHEN count(*) > 1 THEN '[x' || count(*) || ' ' || arg_min(stamp, line_no) || '-' || arg_max(stamp, line_no) || '] ' ELSE '' END || arg_min(raw, line_no) AS raw FROM l GROUP BY host, program, template""",
    "tag_spread": f"{_E}, s AS (SELECT key, count(DISTINCT host) AS hosts FROM l GROUP BY ALL), c AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY line_no) <= 3) SELECT line_no, CASE WHEN hosts > 1 THEN '[on ' || hosts || ' hosts] ' ELSE '' END || raw AS raw FROM c JOIN s USING (key)",
    "template_shapes": f"{_E} SELECT program, template, count(*) AS lines, count(DISTINCT host) AS hosts, count(DISTINCT log_date) AS n_days, arg_min(raw, (log_date, line_no)) AS example, arg_min(host, (log_date, line_no)) AS example_host FROM l GROUP BY ALL",
    "shape_candidates": f"{_E} SELECT program, template, count(*) AS lines, count(DISTINCT host) AS hosts, count(DISTINCT log_date) AS n_days FROM l WHERE length(program) / 100 < 0.07 GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT log_date) >= 3",
    "context_window": f"{_E}, p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY line_no) AS pos FROM l) SELECT a.line_no AS anchor, b.line_no, b.raw FROM p a JOIN p b ON a.host = b.host AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 WHERE a.program = 'error'",
    "fuzzy_anchor": f"""{_E}, a AS (SELECT host || ' ' || program AS example_id, host, program, line_no, raw, head || host || ' ' || key AS bare FROM l QUALIFY row_number() OVER (PARTITION BY host, program ORDER BY line_no) = 1),
 b AS (SELECT line_no, host, program, list_distinct(string_split_regex(raw, '\\s+')) AS b FROM l),
 s AS (SELECT example_id, b.line_no, len(list_intersect(list_distinct(string_split_regex(bare, '\\s+')), b)) AS shared FROM a JOIN b USING (host, program) WHERE program >= 'f')
 SELECT example_id, line_no, false AS exact, CAST(shared AS INTEGER) AS shared FROM s WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY shared DESC, line_no) = 1
 UNION ALL SELECT example_id, line_no, true, CAST(len(list_distinct(string_split_regex(raw, '\\s+'))) AS INTEGER) FROM a WHERE program < 'f'""",
    "line_chunks": f"""{_E}, k AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS pos FROM l WHERE rule_id IS NULL)
 SELECT CAST((pos - 1) // 250 AS BIGINT) AS chunk, count(*) AS n, min(line_no) AS first_line FROM k GROUP BY ALL""",
    "mask_messages": f"SELECT doc_id, {_MASK} AS masked FROM documents",
    "findings_by_host": f"{_F} SELECT id, service, title FROM f WHERE severity = 'high' AND EXISTS (SELECT 1 FROM h WHERE finding_id = id AND host LIKE '%host1%')",
    "findings_by_text": f"{_F} SELECT id, service, title FROM f WHERE lower(title) LIKE '%order 12%' AND lower(service) LIKE '%vc3%'",
    "findings_by_days": f"{_F} SELECT id, log_date, severity FROM f WHERE kind = 'peer' AND log_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'",
    "findings_page": f"{_F} SELECT id, log_date, title FROM f ORDER BY log_date DESC, id LIMIT 50 OFFSET 50",
    "finding_hosts": f"{_F} SELECT finding_id, string_agg(host, ',' ORDER BY pos, host) AS hosts FROM h GROUP BY ALL",
    "run_summary": f"{_F} SELECT run_id, r.log_date, raw_lines, count(*) AS n_findings FROM r JOIN f USING (run_id) GROUP BY ALL",
    "feedback_counts": f"{_F} SELECT id, count(*) FILTER (flag = 'A') AS worked, count(*) FILTER (flag = 'R') AS didnt_work FROM f LEFT JOIN v ON id = finding_id GROUP BY ALL",
    "daily_totals": f"{_E} SELECT log_date, host, program, n FROM td WHERE host = 'host7'",
    "digest_issue_groups": f"{_G} SELECT service, hosts, n_days, severity, latest_id, 'Order ' || latest_id AS title FROM g",
    "digest_anomaly_groups": f"{_F} SELECT host, service AS program, count(DISTINCT log_date) AS n_days, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, arg_max(id, (log_date, id)) AS latest_id FROM f JOIN h ON id = finding_id WHERE kind != 'issue' AND {_P} GROUP BY ALL",
    "digest_missing_days": f"{_F} SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) AS x(d) WHERE CAST(d AS DATE) NOT IN (SELECT log_date FROM r)",
    "digest_recurring": f"{_G} SELECT service, hosts, n_days, latest_id FROM g WHERE n_days >= 2 ORDER BY n_days DESC, rank, service, hosts, latest_id LIMIT 10",
    "digest_one_offs": f"{_G} SELECT service, hosts, severity, latest_id FROM g WHERE n_days = 1 AND rank <= 1 ORDER BY rank, n_hosts DESC, service, hosts, latest_id LIMIT 5",
    "mgmt_days": f"{_D} SELECT * FROM days",
    "mgmt_totals": f"{_D} SELECT count(volume) AS days_with_data, count(*) FILTER (approximate) AS approximate_days, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume, CAST(coalesce(sum(filtered_lines), 0) AS BIGINT) AS filtered, count(filtered_lines) > 0 AS have_filtered, CAST(sum(n_findings) AS BIGINT) AS n_findings FROM days",
    "mgmt_severity": f"{_F} SELECT CASE WHEN kind = 'issue' THEN severity ELSE 'anomaly' END AS label, count(*) AS n FROM f GROUP BY ALL",
    "top_services": f"{_F} SELECT service, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, service LIMIT 5",
    "votes_by_verdict": f"{_F} SELECT CASE WHEN flag = 'A' THEN 'worked' ELSE 'didnt_work' END AS verdict, count(*) AS n FROM v JOIN f ON id = finding_id GROUP BY ALL",
    "flagged_hosts": f"{_F} SELECT host, count(DISTINCT log_date) AS n_days, count(DISTINCT id) AS n_findings FROM f JOIN h ON id = finding_id WHERE {_P} GROUP BY ALL ORDER BY n_days DESC, n_findings DESC, host LIMIT 5",
    "hosts_reporting": f"{_E} SELECT count(DISTINCT host) FILTER (log_date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30') AS hosts_now, count(DISTINCT host) FILTER (log_date BETWEEN DATE '2024-01-09' AND DATE '2024-01-15') AS hosts_before FROM e",
    "noisiest_hosts": f"""{_E}, k AS (SELECT host, program, n, row_number() OVER (PARTITION BY host ORDER BY n DESC, program) AS k, sum(n) OVER (PARTITION BY host) AS total FROM t)
 SELECT host, CAST(total AS BIGINT) AS n, round(total / (SELECT count(DISTINCT log_date) FROM e), 6) AS per_day, program AS top_program, round(n / total, 6) AS share FROM k WHERE k = 1 ORDER BY total DESC, host LIMIT 5""",
    "median_per_host": f"{_E} SELECT round(median(n) / (SELECT count(DISTINCT log_date) FROM e), 6) AS median_per_day, count(*) AS hosts FROM (SELECT host, count(*) AS n FROM e GROUP BY ALL)",
    "movers": f"""{_E}, w AS (SELECT host, count(*) FILTER (log_date < DATE '2024-01-08') / (SELECT count(DISTINCT log_date) FROM e WHERE log_date < DATE '2024-01-08') AS b, count(*) FILTER (log_date > DATE '2024-01-23') / (SELECT count(DISTINCT log_date) FROM e WHERE log_date > DATE '2024-01-23') AS a FROM e GROUP BY ALL)
 SELECT host, round(b, 6) AS before, round(a, 6) AS after FROM w WHERE greatest(a, b) >= 1 AND a != b ORDER BY CASE WHEN a = 0 OR b = 0 THEN 1e300 ELSE abs(ln(a / b)) END DESC, greatest(a, b) DESC, host LIMIT 5""",
}

_T = "(CASE WHEN {0} >= 10 THEN printf('%.0fx', {0}) ELSE printf('%.1fx', {0}) END)"
_N = "format('{{:,}}', CAST({0} AS BIGINT))"
_M = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"
_Q = r"regexp_replace({0}, '([\\.+*?()|\[\]{{}}^$])', '\\\1', 'g')"
_MUTE = f"""{_F}, m AS (SELECT finding_id, host, service AS program FROM f JOIN h ON id = finding_id WHERE {_P} AND severity != 'low')"""
_RX = _Q.format("program") + r" || '(?:\[\d+\])?:? ' || replace(" + _Q.format("template") + r", '<n>', '\d+')"

ORACLES |= {
    "anomaly_facts": f"""{_PEER}, k AS (SELECT host, bool_or(contains(program, 'view')) AS w, bool_or(contains(program, 'syslog')) AS u FROM e GROUP BY ALL)
 SELECT host, program, CASE WHEN length(host) = 6 THEN 'debian' WHEN w AND NOT u THEN 'windows' WHEN u AND NOT w THEN 'unix' ELSE 'unknown' END AS os, example, 'Louder than its peers' AS headline,
 {_N.format("n")} || ' events vs a fleet median of ' || CASE WHEN med = floor(med) THEN CAST(CAST(med AS BIGINT) AS VARCHAR) ELSE printf('%.1f', med) END || ' across peer hosts.' AS summary,
 CASE WHEN program = 'error' THEN 'errors of ' || host END AS explanation
 FROM pa JOIN (SELECT host, program, arg_min(raw, line_no) AS example FROM l GROUP BY ALL) USING (host, program) JOIN k USING (host)""",
    "baseline_texts": f"""{_BASE} SELECT host, program, CASE direction WHEN 'silent' THEN 'Gone silent' WHEN 'louder' THEN 'Louder than its own baseline' ELSE 'Quieter than its own baseline' END AS headline,
 CASE WHEN direction = 'silent' THEN 'No events today - this host normally emits about ' || {_M.format("med")} || '/day of ' || program || ' (median over ' || days_seen || ' days). It has gone silent.'
 ELSE {_N.format("today")} || ' events today, ' || CASE direction WHEN 'quieter' THEN 'down from' ELSE 'up from' END || ' an own ' || days_seen || '-day median of ' || {_M.format("med")} || '.' END AS summary FROM ba""",
    "temporal_texts": f"""{_TEMP} SELECT host, program, 'Burst in the ' || bucket || ' window' AS headline, {_N.format("today")} || ' events in the ' || bucket || ' window today vs an own median of ' || {_M.format("med")}
 || ' for that time of day (over ' || days_seen || ' days) - a burst beyond its usual rhythm.' AS summary FROM ta""",
    "resolved_issues": """SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title, CASE flag WHEN 'A' THEN 'worked' WHEN 'R' THEN 'didnt_work' END AS resolution FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS flag FROM lineitem WHERE l_returnflag IN ('A', 'R')
 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) = 1) ON o_orderkey = l_orderkey WHERE o_orderstatus != 'P'""",
    "most_severe_issues": f"{_F} SELECT id, severity FROM f WHERE kind = 'issue' AND {_P} ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, id LIMIT 60",
    "digest_titles": f"""{_G}, s AS (SELECT service, count(*) AS shared FROM g GROUP BY ALL), b AS (SELECT g.*, CASE WHEN shared > 1 AND hosts != '' THEN service || ' (' || split_part(hosts, ',', 1) || ')' ELSE service END AS base FROM g JOIN s USING (service)),
 n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY n_days DESC, rank, service, hosts, latest_id) AS place FROM b) SELECT latest_id, CASE WHEN place > 1 THEN base || ' #' || place ELSE base END AS unique_title FROM n""",
    "recurrence_sentences": f"""{_F}, d AS (SELECT DISTINCT service, severity, log_date FROM f WHERE {_P})
 SELECT service, severity, 'Seen on ' || count(*) || ' of 7 run days: ' || string_agg(strftime(log_date, '%a %-d %b'), ', ' ORDER BY log_date) AS sentence FROM d GROUP BY ALL""",
    "feedback_list": """SELECT l_orderkey AS finding_id, CAST(l_linenumber AS BIGINT) AS user_id, CASE l_linenumber WHEN 1 THEN 'ann' WHEN 2 THEN 'bo' WHEN 3 THEN 'cy' ELSE '' END AS name, CASE l_returnflag WHEN 'A' THEN 'worked' ELSE 'didnt_work' END AS verdict FROM lineitem
 WHERE l_returnflag IN ('A', 'R') QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) = 1""",
    "finding_mutes": f"{_MUTE} SELECT * FROM m",
    "fresh_mutes": f"{_MUTE} SELECT *, '' AS match FROM m WHERE host != 'host1' OR program = 'svc3'",
    "seed_rules": f"{_E} SELECT min(line_no) AS line, host, program AS match FROM e WHERE host NOT LIKE 'host1%' GROUP BY host, program",
    "entries_overview": f"{_F} SELECT id, 'api' AS source FROM f WHERE kind = 'issue' AND log_date >= DATE '1998-02-24'",
    "shape_regexes": f"{_E} SELECT DISTINCT program, template, {_RX} AS match, true AS fits FROM l",
    "unreviewed_shapes": f"{_E} SELECT program, template, count(*) AS lines FROM l WHERE program >= 'f' GROUP BY ALL",
    "flat_documents": """SELECT event_id, '{"host.name":"host' || (user_id % 20) || '","host.os.version":"6.1",' || CASE WHEN user_id % 2 = 1 THEN '"process.name":"' || event_type || '",' ELSE '' END
 || '"process.pid":' || event_id || ',"message":' || CAST(to_json(props) AS VARCHAR) || '}' AS flat FROM events""",
    "secret_masks": "SELECT event_id, 'login password=**** via ftp://bob:****@h/x ' || props AS shown FROM events",
    "shape_reviews": f"{_E} SELECT DISTINCT program, template, CASE WHEN program < 'f' THEN 'muted' ELSE 'kept' END AS verdict FROM l",
    "volume_bars": f"{_D} SELECT day, CASE WHEN volume > 0 THEN greatest(100 * volume // (SELECT max(volume) FROM days), 1) ELSE 0 END AS percent FROM days WHERE volume IS NOT NULL",
    "mover_labels": f"""SELECT host, CASE WHEN "before" = 0 THEN 'new' WHEN "after" = 0 THEN 'stopped' WHEN "after" > "before" THEN 'up ' || {_T.format('("after" / "before")')} ELSE 'down ' || {_T.format('("before" / "after")')} END AS label FROM ({ORACLES["movers"]})""",
    "score_labels": f"{_E} SELECT host, program, CASE WHEN round(n / 200) < 1 AND n > 0 THEN 'under 1%' ELSE CAST(CAST(round(n / 200) AS BIGINT) AS VARCHAR) || '%' END AS label FROM t",
}

_DAY = "generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) AS x(d)"


def _range(name: str, keys: str, source: str, grid: str, extra: str) -> str:
    """Scores of every day: ``name``_s with today, days_seen, med, mad, ad and score; ``grid`` has the rows that are judged."""
    on = " AND ".join(f"g.{k} = b.{k}" for k in keys.split(", "))
    own = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""{name}_v AS (SELECT {own}, g.day, g.n, list(CAST(b.n AS DOUBLE)) AS v FROM ({grid}) g JOIN {source} b ON {on} AND b.log_date BETWEEN g.day - 14 AND g.day - 1 GROUP BY ALL HAVING count(*) >= 7),
 {name}_m AS (SELECT *, list_median(v) AS med FROM {name}_v), {name}_o AS (SELECT *, [abs(y - med) FOR y IN v] AS o FROM {name}_m),
 {name}_q AS (SELECT {keys}, day, n AS today, n AS x, CAST(len(v) AS BIGINT) AS days_seen, med, list_median(o) AS mad, list_avg(o) AS ad FROM {name}_o),
 {name}_s AS (SELECT *, {_Z} AS score FROM {name}_q){extra}"""


_GRID = f"SELECT s.host, s.program, CAST(d AS DATE) AS day, coalesce(td.n, 0) AS n FROM (SELECT DISTINCT host, program FROM td) s CROSS JOIN {_DAY} LEFT JOIN td ON td.host = s.host AND td.program = s.program AND td.log_date = CAST(d AS DATE)"
_RB = _range("rb", "host, program", "td", _GRID, "")
_QD = "qd AS (SELECT host, program, quarter AS bucket, log_date, count(*) AS n FROM e GROUP BY ALL)"
_RT = _range("rt", "host, program, bucket", "qd", "SELECT host, program, bucket, log_date AS day, n FROM qd", "")
_RP = f"""dm AS (SELECT program, log_date, median(n) AS med, count(*) AS peers FROM td GROUP BY ALL), dx AS (SELECT td.*, n AS x, med, peers, abs(n - med) AS off FROM td JOIN dm USING (program, log_date)),
 dq AS (SELECT program, log_date, median(off) AS mad, avg(off) AS ad FROM dx GROUP BY ALL), rp AS (SELECT host, program, log_date AS day, n, peers, {_Z} AS score FROM dx JOIN dq USING (program, log_date))"""
ORACLES |= {
    "range_baselines": f"{_E}, {_RB} SELECT host, program, day AS log_date, today, days_seen, round(med, 6) AS median, round(mad, 6) AS mad, round(score, 6) AS score FROM rb_s",
    "range_temporal": f"{_E}, {_QD}, {_RT} SELECT host, program, bucket, day AS log_date, today, days_seen, round(med, 6) AS median, round(mad, 6) AS mad, round(score, 6) AS score FROM rt_s",
    "range_anomalies": f"""{_E}, {_QD}, {_RB}, {_RT}, {_RP},
 ra AS (SELECT *, CASE WHEN today = 0 AND med >= 1 THEN 'silent' WHEN score > 0 THEN 'louder' ELSE 'quieter' END AS direction FROM rb_s WHERE med >= 1 AND (today = 0 OR abs(score) >= 2)),
 u AS (SELECT day, host, program, 'peer' AS kind, 0 AS o, '' AS bucket, score FROM rp WHERE peers >= 5 AND n >= 3 AND score > 0 UNION ALL SELECT day, host, program, 'baseline', 1, '', score FROM ra
  UNION ALL SELECT day, host, program, 'temporal', 2, bucket, score FROM rt_s WHERE today >= 1 AND score >= 2),
 c AS (SELECT * FROM u WHERE host != 'host3' OR day > DATE '2024-01-20' QUALIFY row_number() OVER (PARTITION BY day, host, program ORDER BY abs(score) DESC, o, score DESC, bucket) = 1)
 SELECT c.day AS log_date, c.host, c.program, kind, bucket, direction, round(c.score, 6) AS score FROM c LEFT JOIN ra ON ra.day = c.day AND ra.host = c.host AND ra.program = c.program""",
    "captured_library": f"""{_F}, y AS (SELECT f.*, year(log_date) AS y FROM f), a AS (SELECT id AS old, title, y, row_number() OVER (ORDER BY y, id) AS id, dense_rank() OVER (ORDER BY y) AS run_id FROM y),
 b AS (SELECT id, old, run_id, title, true AS first FROM a WHERE y != 1995 UNION ALL SELECT row_number() OVER (ORDER BY id) + (SELECT count(*) FROM f), id, (SELECT count(DISTINCT y) FROM y) + 1, title, false FROM y WHERE y = 1995 AND severity IN ('critical', 'high')),
 k AS (SELECT finding_id, count(*) FILTER (flag = 'A') AS worked, count(*) FILTER (flag = 'R') AS didnt_work FROM v GROUP BY ALL), n AS (SELECT finding_id, count(*) AS n_hosts FROM h GROUP BY ALL)
 SELECT b.id, run_id, title, coalesce(n_hosts, 0) AS n_hosts, CASE WHEN first THEN coalesce(worked, 0) ELSE 0 END AS worked, CASE WHEN first THEN coalesce(didnt_work, 0) ELSE 0 END AS didnt_work,
 CAST(CASE WHEN first THEN 100 ELSE 50 END AS BIGINT) AS raw_lines, CAST(CASE WHEN NOT first THEN 5 END AS BIGINT) AS filtered_lines FROM b LEFT JOIN k ON k.finding_id = old LEFT JOIN n ON n.finding_id = old""",
    "stored_votes": """WITH o AS (SELECT o_orderkey AS old, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders), v AS (SELECT l_orderkey AS old, l_linenumber AS u, l_returnflag AS flag, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag IN ('A', 'R')
 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_returnflag DESC) = 1)
 SELECT id AS finding_id, CAST(CASE WHEN u = 7 THEN -1 ELSE u END AS BIGINT) AS user_id, CASE flag WHEN 'A' THEN 'worked' ELSE 'didnt_work' END AS verdict, CASE WHEN u % 2 = 1 THEN 'c' || id ELSE '' END AS comment, day FROM v JOIN o USING (old)""",
    "cached_views": f"{_E} SELECT DISTINCT program, template, CASE WHEN program < 'f' THEN 0.5 ELSE length(program) / 10 END AS score, CASE WHEN program < 'f' THEN DATE '2024-01-02' ELSE DATE '2024-01-01' END AS day FROM l",
    "mute_hits": f"""{_PEER}, a AS (SELECT CASE WHEN host LIKE 'host1%' AND program = 'error' THEN 1 WHEN length(host) = 5 AND program LIKE 's%' THEN 3 END AS rule_id, host FROM pa), u AS (SELECT rule_id, host, 1 AS lines, 0 AS anomalies FROM l WHERE rule_id IS NOT NULL UNION ALL SELECT rule_id, host, 0, 1 FROM a WHERE rule_id IS NOT NULL)
 SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(anomalies) AS BIGINT) AS anomalies, count(DISTINCT host) AS hosts FROM u GROUP BY ALL""",
}

_EMAIL = r"[0-9A-Za-z_.+%-]+@[0-9A-Za-z_-]+(?:\.[0-9A-Za-z_-]+)+"
_REQ = f"""WITH t AS (SELECT lang AS request, doc_id AS line_no, text || ' see www.example.com or 233.1.2.3 and Mail2.Example.com, boss@mail2.example.com' AS text FROM documents),
 m AS (SELECT request, line_no, text, regexp_extract_all(text, '{_EMAIL}') AS found FROM t), o AS (SELECT request, line_no, unnest(range(1, len(found) + 1)) AS k, unnest(found) AS email FROM m),
 f AS (SELECT request, email, min((line_no, k)) AS first FROM o GROUP BY ALL), nr AS (SELECT request, email, row_number() OVER (PARTITION BY request ORDER BY first) AS number FROM f)"""
_OUT = "text"
for _real, _fake in ((r"mail2\.example\.com", "post.invalid"), (r"example\.com", "corp.invalid")):
    _OUT = rf"regexp_replace({_OUT}, '\b{_real}\b', '{_fake}', 'gi')"
for _real, _fake in ((r"114\.203", "172.16.3"), ("233", "10.9")):
    _OUT = rf"regexp_replace({_OUT}, '\b{_real}\.', '{_fake}.', 'g')"
ORACLES |= {
    "scrub_tokens": f"{_REQ} SELECT request, number, email FROM nr",
    # of a text with addresses the pieces between them, each followed by its token
    "scrubbed_texts": f"""{_REQ}, n AS (SELECT request, line_no, list('<email-' || number || '>' ORDER BY o.k) AS marks FROM o JOIN nr USING (request, email) GROUP BY ALL),
 j AS (SELECT request, line_no, array_to_string([p || coalesce(marks[i], '') FOR p, i IN regexp_split_to_array(text, '{_EMAIL}')], '') AS text FROM m JOIN n USING (request, line_no)) SELECT request, line_no, {_OUT} AS text FROM j""",
    "restored_texts": f"{_REQ} SELECT request, line_no, replace(text, 'Mail2.Example.com', 'mail2.example.com') AS text FROM t",
    "budget_payloads": """WITH d AS (SELECT lang, doc_id, greatest(n_chars, 1) AS n, coalesce(sum(greatest(n_chars, 1)) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM documents),
 p AS (SELECT *, CAST(2 * (s // 2000) + CASE WHEN s // 2000 != (s + n - 1) // 2000 THEN 1 ELSE 0 END AS BIGINT) AS payload FROM d)
 SELECT lang, payload, count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens, min(doc_id) AS first, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS text FROM p GROUP BY ALL""",
    "anomaly_payloads": f"""{_PEER}, x AS (SELECT host, program, arg_min(raw, line_no) AS example FROM l GROUP BY ALL), r AS (SELECT pa.*, example, row_number() OVER (ORDER BY round(score, 6) DESC, host, program) AS pos FROM pa LEFT JOIN x USING (host, program)),
 tt AS (SELECT pos, (pos - 1) // 15 AS payload, ((pos - 1) % 15 + 1) || '. host=' || host || ' program=' || program || ' os_family=unix what=''Louder than its peers'' detail=''' || {_N.format("n")} || ' events vs a fleet median of '
 || CASE WHEN med = floor(med) THEN CAST(CAST(med AS BIGINT) AS VARCHAR) ELSE printf('%.1f', med) END || ' across peer hosts.'' example=''' || example || '''' AS line FROM r)
 SELECT CAST(payload AS BIGINT) AS payload, count(*) AS n, min(pos) AS first, string_agg(line, chr(10) ORDER BY pos) AS text FROM tt GROUP BY ALL""",
    "issue_payloads": f"""{_F}, rr AS (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, id) AS pos FROM f WHERE kind = 'issue' AND {_P}),
 t AS (SELECT pos, (pos - 1) // 12 AS payload, '  {{' || chr(10) || '    "id": ' || id || ',' || chr(10) || '    "title": "' || title || '",' || chr(10) || '    "severity": "' || severity || '",' || chr(10) || '    "service": "' || service || '"' || chr(10) || '  }}' AS obj FROM rr)
 SELECT CAST(payload AS BIGINT) AS payload, count(*) AS n, '[' || chr(10) || string_agg(obj, ',' || chr(10) ORDER BY pos) || chr(10) || ']' AS text FROM t GROUP BY ALL""",
    "line_payloads": f"""WITH c AS ({ORACLES["collapse_repeats"]}), k AS (SELECT line_no, raw, (row_number() OVER (ORDER BY line_no) - 1) // 250 AS payload FROM c)
 SELECT CAST(payload AS BIGINT) AS payload, count(*) AS n, min(line_no) AS first, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM k GROUP BY ALL""",
}

_K = r"""CAST(regexp_extract(props, '"k": ([0-9]+)\}', 1) AS BIGINT)"""
ORACLES |= {
    "many_rules": f"{_E}, x AS (SELECT line_no, CAST(host[5:] AS BIGINT) AS h, {_K} AS k FROM l) SELECT line_no, CASE WHEN k % 2 = 0 AND k < 100 THEN 100 * h + k + 1 END AS rule_id FROM x",
    "many_normalised": f"""{_E}, x AS (SELECT *, CASE WHEN program = 'view' AND {_K} % 3 = 0 AND {_K} < 100 THEN 'view ' || {_K} WHEN program = 'error' THEN 'an error' END AS what FROM l)
 SELECT line_no, CASE WHEN what IS NULL THEN raw ELSE short_head || host || ' ' || what END AS raw FROM x""",
}

_MONTHS = f"""{_F}, q AS (SELECT id, kind, severity, service, CAST(date_trunc('month', log_date) AS DATE) AS m FROM f), i AS (SELECT *, row_number() OVER (ORDER BY m, id) AS nid, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS rank FROM q),
 hl AS (SELECT finding_id, string_agg(host, ',' ORDER BY host) AS hosts, count(*) AS n_hosts FROM h GROUP BY ALL), w AS (SELECT i.*, coalesce(hosts, '') AS hosts, coalesce(n_hosts, 0) AS n_hosts FROM i LEFT JOIN hl ON i.id = finding_id WHERE kind = 'issue'),
 g AS (SELECT service, hosts, n_hosts, count(DISTINCT m) AS n_days, min(rank) AS rank, arg_min(severity, rank) AS severity, arg_max(nid, (m, nid)) AS latest_id FROM w GROUP BY service, hosts, n_hosts),
 a AS (SELECT row_number() OVER (ORDER BY n_days DESC, rank, service, hosts, latest_id) AS k, 0 AS s, * FROM g WHERE n_days >= 2 QUALIFY k <= 10),
 b AS (SELECT row_number() OVER (ORDER BY rank, n_hosts DESC, service, hosts, latest_id) AS k, 1 AS s, * FROM g WHERE n_days = 1 AND rank <= 1 QUALIFY k <= 5),
 p AS (SELECT host, service, count(DISTINCT m) AS n_days, arg_max(nid, (m, nid)) AS latest_id FROM i JOIN h ON i.id = finding_id WHERE kind != 'issue' GROUP BY ALL),
 c AS (SELECT row_number() OVER (ORDER BY n_days DESC, host, service) AS k, 2 AS s, * FROM p QUALIFY k <= 15),
 u AS (SELECT s, k, 'issue' AS finding_kind, severity, service, hosts, n_days, latest_id FROM a UNION ALL SELECT s, k, 'issue', severity, service, hosts, n_days, latest_id FROM b UNION ALL SELECT s, k, 'peer', '', service, host, n_days, latest_id FROM c)"""
ORACLES |= {
    "digest_filed": f"{_MONTHS} SELECT row_number() OVER (ORDER BY s, k) - 1 AS pos, finding_kind, severity, service, hosts, n_days, latest_id FROM u",
    "compact_numbers": "SELECT l_orderkey, l_linenumber, printf('%.6g', CAST(l_extendedprice AS DOUBLE) * pow(10.0, l_linenumber * 3 - 12)) AS shown FROM lineitem",
    "period_labels": """WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b, count(*) AS n FROM orders GROUP BY ALL)
 SELECT o_custkey, CASE WHEN year(a) = year(b) THEN strftime(a, '%d %b') ELSE strftime(a, '%d %b %Y') END || ' to ' || strftime(b, '%d %b %Y') AS period, strftime(a, '%a %d %b') AS short, strftime(b, '%d/%m/%Y') AS plain,
 CASE WHEN n % 3 != 0 THEN printf('%.1f%% filtered out as routine noise', round_even(100 * (n - n // 3) / n, 1)) END AS reduction FROM s""",
}

_SECRET = "text"
for _pattern, _kept in (
    (r"((?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key)[\"'']?\s*[=:]\s*)(?:\"[^\"]*\"|''[^'']*''|[^\s,;&\"'']+)", r"\1****"),
    (r"\b((?:bearer|basic)\s+)[a-z0-9+/=._~-]{8,}", r"\1****"), (r"(\b[a-z][a-z0-9+.-]*://[^\s:/@]*:)[^\s/@]+@", r"\1****@"),
):
    _SECRET = f"regexp_replace({_SECRET}, '{_pattern}', '{_kept}', 'gi')"
_SECRET = rf"regexp_replace({_SECRET}, '\b(?:AKIA|ASIA)[0-9A-Z]{{16}}\b|\bgh[opsu]_[0-9A-Za-z]{{36}}\b|\beyJ[\w-]+\.[\w-]+\.[\w-]*', '****', 'g')"
ORACLES["document_secrets"] = f"SELECT doc_id, {_SECRET} AS shown FROM documents"
