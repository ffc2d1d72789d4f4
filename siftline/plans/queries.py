"""The registered queries of the engine's own operators, each over whole tables."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as B
from ..functions import lines as L
from ..operators import detect, digest, facts, filtering, library, mgmt, mutes, payloads, scrub, shapes
from ..sources import logs
from ..sources.store import Store
from ..sources.versions import shared_folder
from . import daily, reports
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
TODAY = datetime.date(2024, 1, 30)
RULES = [
    filtering.Rule(1, "host1*", "error"), filtering.Rule(2, match='"k": 8[0-9]'), filtering.Rule(3, "host?", "s*"),
    filtering.Rule(4, "*", "*", expires=datetime.date(2023, 12, 31)),
]
TABLE = [(r"error\[", "an error"), (r'"k": [0-4][0-9]\}', "a low k")]
PERIOD = ("1998-03-01", "1998-03-07")
MONTH = ("2024-01-01", "2024-01-30")
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(name: str, places: int = 6):
    return F.round(F.col(name).cast("double"), places).alias(name)


@query
def parse_lines(spark, d):
    return T.parsed(spark, d).select("line_no", "host", "program", "bucket", "stamp")


@query
def window_counts(spark, d):
    return detect.window_counts(T.parsed(spark, d))


@query
def pair_totals(spark, d):
    return detect.pair_totals(T.counts(spark, d))


@query
def host_programs(spark, d):
    return detect.host_programs(T.counts(spark, d)).select("host", F.array_join("programs", ",").alias("programs"))


@query
def first_example(spark, d):
    return detect.first_examples(T.parsed(spark, d))


@query
def peer_scores(spark, d):
    return detect.peer_scores(detect.pair_totals(T.counts(spark, d))).select("host", "program", "n", "peers", _r("median"), _r("score"))


@query
def peer_anomalies(spark, d):
    found = detect.peer_anomalies(detect.pair_totals(T.counts(spark, d)), min_count=10)
    return detect.ranked(found.select("host", "program", "n", "peers", _r("score")))


@query
def baseline_scores(spark, d):
    return detect.baseline_scores(T.counts(spark, d), TODAY).select("host", "program", "today", "days_seen", _r("median"), _r("score"))


@query
def baseline_anomalies(spark, d):
    found = detect.baseline_anomalies(detect.baseline_scores(T.counts(spark, d), TODAY), 1, 1, 2)
    return found.select("host", "program", "today", "direction", _r("score"))


@query
def temporal_scores(spark, d):
    return detect.temporal_scores(T.quarter_counts(spark, d), TODAY).select("host", "program", "bucket", "today", "days_seen", _r("median"), _r("score"))


@query
def temporal_anomalies(spark, d):
    found = detect.temporal_anomalies(detect.temporal_scores(T.quarter_counts(spark, d), TODAY), 1, 2)
    return found.select("host", "program", "bucket", "today", _r("score"))


@query
def combined_anomalies(spark, d):
    counts = T.counts(spark, d)
    peer = detect.peer_anomalies(detect.pair_totals(counts), min_count=10)
    base = detect.baseline_anomalies(detect.baseline_scores(counts, TODAY), 1, 1, 2)
    times = detect.temporal_anomalies(detect.temporal_scores(T.quarter_counts(spark, d), TODAY), 1, 2)
    return detect.ranked(detect.combine(peer, base, times)).select("host", "program", "kind", "bucket", _r("score"))


@query
def trailing_baselines(spark, d):
    return detect.trailing_baselines(T.counts(spark, d)).select("host", "program", "log_date", "n", "days_seen", _r("median"))


@query
def known_filter(spark, d):
    tagged = filtering.with_rule(T.lines(spark, d), filtering.active(RULES, TODAY))
    return tagged.where("rule_id IS NULL").select("line_no", "raw")


@query
def known_hits(spark, d):
    return filtering.known_hits(filtering.with_rule(T.lines(spark, d), filtering.active(RULES, TODAY)))


@query
def hit_messages(spark, d):
    return filtering.hit_messages(filtering.with_rule(T.lines(spark, d), filtering.active(RULES, TODAY)), 2)


@query
def mute_anomalies(spark, d):
    found = detect.peer_anomalies(detect.pair_totals(T.counts(spark, d)), min_count=10)
    return filtering.mute(found, filtering.active(RULES, TODAY)).select("host", "program", "n", _r("score"))


@query
def normalise_lines(spark, d):
    return filtering.normalise(T.lines(spark, d), TABLE).select("line_no", "raw")


@query
def cap_repeats(spark, d):
    return filtering.cap_repeats(T.lines(spark, d)).select("line_no", "raw")


@query
def message_spread(spark, d):
    return filtering.spread(T.lines(spark, d))


@query
def log_filter(spark, d):
    return filtering.log_filter(T.lines(spark, d), filtering.active(RULES, TODAY), TABLE).select("line_no", "raw")


@query
def collapse_repeats(spark, d):
    return filtering.collapse(T.lines(spark, d))


@query
def tag_spread(spark, d):
    lines = T.lines(spark, d)
    return filtering.tag_spread(filtering.cap_repeats(lines), filtering.spread(lines)).select("line_no", "raw")


@query
def mask_messages(spark, d):
    host = F.concat(F.lit("host"), (F.col("doc_id") % 20).cast("string"))
    return T.table(spark, d, "documents").select("doc_id", L.mask(F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" ")), host).alias("masked"))


@query
def template_shapes(spark, d):
    return shapes.tally(L.templates(T.parsed(spark, d)))


@query
def shape_candidates(spark, d):
    tallied = shapes.tally(L.templates(T.parsed(spark, d)))
    scores = tallied.select("program", "template", (F.length("program") / 100).alias("score"))
    return shapes.candidates(tallied, scores, threshold=0.07).select("program", "template", "lines", "hosts", "n_days")


@query
def context_window(spark, d):
    lines = _stored(spark).once(T.parsed(spark, d).where("host IS NOT NULL").select("line_no", "host", "program", "raw"))
    return shapes.context(lines, lines.where("program = 'error'").select(F.col("line_no").alias("anchor")), 2)


def _examples(lines):
    """The first line of each host and program as an example; some without their pids, as models return them."""
    first = detect.first_examples(lines)
    raw = F.when(F.col("program") < "f", F.col("example")).otherwise(F.regexp_replace("example", r"\[[0-9]+\]", ""))
    return first.select(F.concat_ws(" ", "host", "program").alias("example_id"), "host", "program", raw.alias("raw"))


@query
def fuzzy_anchor(spark, d):
    lines = _stored(spark).once(T.parsed(spark, d).where("host IS NOT NULL").select("line_no", "host", "program", "raw"))
    return shapes.anchors(lines, _examples(lines))


@query
def line_chunks(spark, d):
    kept = filtering.with_rule(T.lines(spark, d), filtering.active(RULES, TODAY)).where("rule_id IS NULL")
    return shapes.chunks(kept).groupBy("chunk").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query
def findings_by_host(spark, d):
    return library.search(T.findings(spark, d), T.hosts(spark, d), host="HOST1", severity="high").select("id", "service", "title")


@query
def findings_by_text(spark, d):
    return library.search(T.findings(spark, d), T.hosts(spark, d), title="order 12", service="VC3").select("id", "service", "title")


@query
def findings_by_days(spark, d):
    return library.search(T.findings(spark, d), T.hosts(spark, d), kind="peer", first="1997-01-01", last="1997-06-30").select("id", "log_date", "severity")


@query
def findings_page(spark, d):
    return library.page(T.findings(spark, d), limit=50, offset=50).select("id", "log_date", "title")


@query
def finding_hosts(spark, d):
    return library.host_lists(T.hosts(spark, d))


@query
def run_summary(spark, d):
    return library.run_summary(T.runs(spark, d), T.findings(spark, d)).select("run_id", "log_date", "raw_lines", "n_findings")


@query
def feedback_counts(spark, d):
    return library.with_votes(T.findings(spark, d), T.votes(spark, d)).select("id", "worked", "didnt_work")


@query
def daily_totals(spark, d):
    return library.daily_totals(T.counts(spark, d), host="host7")


def _groups(spark, d):
    return digest.issue_groups(digest.within(T.findings(spark, d), *PERIOD), T.hosts(spark, d))


@query
def digest_issue_groups(spark, d):
    return digest.rank_issues(_groups(spark, d)).select("service", "hosts", "n_days", "severity", "latest_id", "title")


@query
def digest_anomaly_groups(spark, d):
    return digest.anomaly_groups(digest.within(T.findings(spark, d), *PERIOD), T.hosts(spark, d))


@query
def digest_missing_days(spark, d):
    return digest.missing_days(T.runs(spark, d), "1995-01-01", "2001-08-01")


@query
def digest_recurring(spark, d):
    return digest.recurring(_groups(spark, d), 7).select("service", "hosts", "n_days", "latest_id")


@query
def digest_one_offs(spark, d):
    return digest.one_offs(_groups(spark, d), 7).select("service", "hosts", "severity", "latest_id")


@query
def mgmt_days(spark, d):
    day = F.date_sub("log_date", 9438)  # 2024-01 to 1998-03
    counts = T.counts(spark, d).withColumn("log_date", day)
    return mgmt.day_rows(T.runs(spark, d), counts, T.findings(spark, d), "1998-03-01", "1998-03-30")


@query
def mgmt_totals(spark, d):
    return mgmt.totals(mgmt_days(spark, d))


@query
def mgmt_severity(spark, d):
    return mgmt.by_severity(T.findings(spark, d))


@query
def top_services(spark, d):
    return mgmt.top_services(T.findings(spark, d))


@query
def votes_by_verdict(spark, d):
    return mgmt.votes_by_verdict(T.votes(spark, d), T.findings(spark, d))


@query
def flagged_hosts(spark, d):
    return mgmt.flagged_hosts(digest.within(T.findings(spark, d), *PERIOD), T.hosts(spark, d))


@query
def hosts_reporting(spark, d):
    return mgmt.hosts_reporting(T.counts(spark, d), "2024-01-16", "2024-01-30", 15)


@query
def noisiest_hosts(spark, d):
    return mgmt.noisiest_hosts(T.counts(spark, d), *MONTH).select("host", "n", _r("per_day"), "top_program", _r("share"))


@query
def median_per_host(spark, d):
    return mgmt.median_per_host(T.counts(spark, d), *MONTH).select(_r("median_per_day"), "hosts")


@query
def movers(spark, d):
    return mgmt.movers(T.counts(spark, d), *MONTH, 30, floor=1).select("host", _r("before"), _r("after"))


@query
def anomaly_facts(spark, d):
    lines = T.parsed(spark, d)
    counts = detect.window_counts(lines, "log_date")
    found = detect.peer_anomalies(detect.pair_totals(counts), min_count=10)
    families = detect.host_programs(counts).select("host", L.os_family(F.col("programs"), ["view"], ["syslog"]).alias("os_family"))
    inventory = T.inventory(spark, d)
    explained = facts.explained(facts.with_facts(found, detect.first_examples(lines), families, inventory), T.explanations(spark, d))
    summary = B.peer_summary(F.col("n"), F.col("median")).alias("summary")
    return explained.select("host", "program", "os", "example", F.lit(B.PEER_HEADLINE).alias("headline"), summary, "explanation")


@query
def baseline_texts(spark, d):
    found = detect.baseline_anomalies(detect.baseline_scores(T.counts(spark, d), TODAY), 1, 1, 2)
    text = B.baseline_summary(F.col("program"), F.col("direction"), F.col("today"), F.col("median"), F.col("days_seen"))
    return found.select("host", "program", B.baseline_headline(F.col("direction")).alias("headline"), text.alias("summary"))


@query
def temporal_texts(spark, d):
    found = detect.temporal_anomalies(detect.temporal_scores(T.quarter_counts(spark, d), TODAY), 1, 2)
    text = B.burst_summary(F.col("today"), F.col("bucket"), F.col("median"), F.col("days_seen"))
    return found.select("host", "program", B.burst_headline(F.col("bucket")).alias("headline"), text.alias("summary"))


@query
def resolved_issues(spark, d):
    issues = T.findings(spark, d).where("kind = 'issue'")
    said = T.votes(spark, d).select(F.col("user_id").alias("pos"), F.concat(F.lit("Order "), F.col("finding_id").cast("string")).alias("title"), F.col("verdict").alias("resolution"))
    return facts.resolved(issues, said).select("id", "title", "resolution")


@query
def most_severe_issues(spark, d):
    return facts.most_severe(digest.within(T.findings(spark, d), *PERIOD).where("kind = 'issue'"), 60).select("id", "severity")


@query
def digest_titles(spark, d):
    # services as titles, so that several groups share each
    return facts.unique_titles(_groups(spark, d).withColumn("title", F.col("service"))).select("latest_id", "unique_title")


@query
def recurrence_sentences(spark, d):
    held = digest.within(T.findings(spark, d), *PERIOD).groupBy("service", "severity").agg(F.collect_set("log_date").alias("days"))
    return held.select("service", "severity", B.recurrence(F.col("days"), F.lit(7)).alias("sentence"))


@query
def feedback_list(spark, d):
    users = spark.createDataFrame([(1, "ann"), (2, "bo"), (3, "cy")], "id long, name string")
    return library.feedback(T.votes(spark, d), users).select("finding_id", "user_id", "name", "verdict")


def _entries(spark, d):
    """Entries that would mute each finding of the week; services of low findings are no names."""
    service = F.when(F.col("severity") == "low", F.concat("service", F.lit(" x"))).otherwise(F.col("service"))
    found = digest.within(T.findings(spark, d), *PERIOD).select("id", F.lit(None).cast("string").alias("program"), service.alias("service"))
    return mutes.from_findings(found, T.hosts(spark, d))


@query
def finding_mutes(spark, d):
    return _entries(spark, d)


@query
def fresh_mutes(spark, d):
    entries = _entries(spark, d).withColumn("match", F.lit(""))
    # those of host1 are there already, of svc3 until the day before
    expires = F.when(F.col("program") == "svc3", F.lit(TODAY - datetime.timedelta(days=1)))
    existing = entries.where("host = 'host1'").withColumn("expires", expires)
    return mutes.fresh(entries, existing, TODAY)


@query
def seed_rules(spark, d):
    lines = T.parsed(spark, d).where("host IS NOT NULL")
    rules = lines.select(F.col("line_no").alias("line"), "host", F.col("program").alias("match"))
    existing = rules.where("host LIKE 'host1%'").select("host", "match")
    return mutes.seeds(rules, existing)


@query
def entries_overview(spark, d):
    entries = T.findings(spark, d).select("id", F.when(F.col("kind") == "peer", "bundled").otherwise("api").alias("source"), F.col("log_date").cast("timestamp").alias("created_at"))
    return mutes.overview(entries, mutes.since("2w", datetime.datetime(1998, 3, 10))).select("id", "source")


@query
def shape_regexes(spark, d):
    return mutes.shape_matches(shapes.tally(L.templates(T.parsed(spark, d)))).select("program", "template", "match", "fits")


@query
def shape_reviews(spark, d):
    tallied = shapes.tally(L.templates(T.parsed(spark, d)))
    return mutes.reviewed(tallied, tallied.where("program < 'f'")).select("program", "template", "verdict")


@query
def volume_bars(spark, d):
    days = mgmt_days(spark, d)
    most = days.agg(F.max("volume").alias("most"))  # one row
    return days.crossJoin(F.broadcast(most)).where("volume IS NOT NULL").select("day", B.bar(F.col("volume"), F.col("most")).alias("percent"))


@query
def mover_labels(spark, d):
    return mgmt.movers(T.counts(spark, d), *MONTH, 30, floor=1).select("host", B.change(F.round("before", 6), F.round("after", 6)).alias("label"))


@query
def score_labels(spark, d):
    return detect.pair_totals(T.counts(spark, d)).select("host", "program", B.percent(F.col("n") / 20000).alias("label"))


@query
def unreviewed_shapes(spark, d):
    tallied = shapes.tally(L.templates(T.parsed(spark, d)))
    # names before f were looked at within the month, names from p long before it
    seen = tallied.where("program < 'f' OR program >= 'p'").select("program", "template", F.when(F.col("program") < "f", F.lit("2024-01-05")).otherwise("2023-06-01").cast("timestamp").alias("created_at"))
    return shapes.unreviewed(tallied, seen, MONTH[0]).select("program", "template", "lines")


@query
def flat_documents(spark, d):
    """Events as nested documents, those of even users without a name of the process."""
    host = F.struct(F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")).alias("name"), F.struct(F.lit("6.1").alias("version")).alias("os"))
    process = F.struct(F.when(F.col("user_id") % 2 == 1, F.col("event_type")).alias("name"), F.col("event_id").alias("pid"))
    doc = F.to_json(F.struct(F.col("props").alias("message"), F.lit(1).alias("other"), process.alias("process"), host.alias("host")))
    return logs.flattened(T.table(spark, d, "events").select("event_id", doc.alias("raw"))).select("event_id", "flat")


@query
def secret_masks(spark, d):
    said = F.concat(F.lit("login password="), F.col("event_id").cast("string"), F.lit(" via ftp://bob:"), F.col("event_type"), F.lit("@h/x "), F.col("props"))
    return T.table(spark, d, "events").select("event_id", L.mask_secrets(said).alias("shown"))


DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(30)]
LIMITS = {"peer": {"min_count": 3}, "baseline": {"min_baseline": 1, "min_silent": 1, "threshold": 2}, "temporal": {"min_count": 1, "threshold": 2}}


@query
def range_baselines(spark, d):
    """Every day of the month against its own two weeks before, in one plan."""
    return detect.range_baseline_scores(T.counts(spark, d), DAYS).select("host", "program", "log_date", "today", "days_seen", _r("median"), _r("mad"), _r("score"))


@query
def range_temporal(spark, d):
    return detect.range_temporal_scores(T.quarter_counts(spark, d), DAYS).select("host", "program", "bucket", "log_date", "today", "days_seen", _r("median"), _r("mad"), _r("score"))


@query
def range_anomalies(spark, d):
    counts = _stored(spark).once(T.quarter_counts(spark, d))
    found = daily.range_anomalies(counts, DAYS, [filtering.Rule(1, "host3", "*", expires=DAYS[19])], **LIMITS)
    return found.select("log_date", "host", "program", "kind", "bucket", "direction", _r("score"))


def _stored(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")


def _yearly(spark, d, each="year"):
    """Findings as runs of a year (or month) each, in the order of their ids."""
    hosts = T.hosts(spark, d).groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "host"))).alias("h"))
    held = T.findings(spark, d).join(hosts, F.col("id") == F.col("finding_id"), "left")
    return held.select(
        F.trunc("log_date", each).alias("log_date"), F.col("id").alias("pos"), F.col("kind").alias("finding_kind"), "severity", "title", "service",
        F.coalesce(F.transform("h", lambda p: p["host"]), F.array().cast("array<string>")).alias("hosts"), F.to_json(F.struct("service", "severity")).alias("payload"),
    )


@query
def captured_library(spark, d):
    """Runs of all findings by year, voted on; the run of 1995 is done again with severe ones alone, so its votes go."""
    store = _stored(spark)
    rows = store.once(_yearly(spark, d))
    years = [r.log_date for r in rows.select("log_date").distinct().collect()]
    store.capture_days(rows, {day: (100, -1) for day in years}, "daily")
    named = store.findings().select(F.col("id").alias("new"), F.col("pos").alias("finding_id"))
    store.vote(T.votes(spark, d).join(named, "finding_id").select(F.col("new").alias("finding_id"), "user_id", "verdict", "comment", F.col("created_at").cast("timestamp").alias("created_at")))
    again = datetime.date(1995, 1, 1)
    store.capture(rows.where(F.col("log_date") == F.lit(again)).where("severity IN ('critical', 'high')"), again, "daily", 50, 5)
    found = library.with_votes(store.findings(), store.votes())
    sizes = store.hosts().groupBy("finding_id").agg(F.count("*").alias("n_hosts"))
    runs = store.runs().select("run_id", "raw_lines", "filtered_lines")
    out = found.join(sizes, F.col("id") == F.col("finding_id"), "left").join(runs, "run_id")
    return out.select("id", "run_id", "title", F.coalesce("n_hosts", F.lit(0)).alias("n_hosts"), "worked", "didnt_work", "raw_lines", "filtered_lines")


@query
def stored_votes(spark, d):
    """All votes in two rounds: odd users first, then everyone; a second vote without a comment keeps the first one's."""
    store, rows = _stored(spark), _yearly(spark, d).withColumn("log_date", F.lit(TODAY))
    store.capture(rows, TODAY, "daily")
    named = store.findings().select(F.col("id").alias("new"), F.col("pos").alias("finding_id"))
    votes = T.votes(spark, d).join(named, "finding_id").select(
        F.col("new").alias("finding_id"), F.when(F.col("user_id") != 7, F.col("user_id")).alias("user_id"), "verdict", F.lit("").alias("comment"), F.col("created_at").cast("timestamp").alias("created_at")
    )
    first = votes.where("user_id IS NULL OR user_id % 2 = 1")
    early = first.withColumns({"verdict": F.lit("worked"), "comment": F.concat(F.lit("c"), F.col("finding_id").cast("string")), "created_at": F.lit("1990-01-01").cast("timestamp")})
    store.vote(early)
    store.vote(votes)
    return store.votes().select("finding_id", F.coalesce("user_id", F.lit(-1)).alias("user_id"), "verdict", "comment", F.to_date("created_at").alias("day"))


@query
def cached_views(spark, d):
    """What was said of every shape, said again of those before f."""
    store = _stored(spark)
    tallied = store.once(shapes.tally(L.templates(T.parsed(spark, d))))
    said = lambda score, day: tallied.select(
        "program", "template", score.alias("score"), F.lit("m").alias("score_model"), F.lit(False).alias("refused"), F.lit(None).cast("string").alias("explanation"),
        F.lit(None).cast("string").alias("explain_model"), F.lit(day).cast("timestamp").alias("created_at"),
    )
    store.save_views(said(F.length("program") / 10, "2024-01-01"))
    store.save_views(said(F.lit(0.5), "2024-01-02").where("program < 'f'"))
    return store.views().select("program", "template", _r("score"), F.to_date("created_at").alias("day"))


@query
def mute_hits(spark, d):
    """Rules with the lines they drop and the anomalies they mute."""
    rules = filtering.active(RULES, TODAY)
    hits = filtering.host_hits(filtering.with_rule(T.lines(spark, d), rules))
    found = detect.peer_anomalies(detect.pair_totals(T.counts(spark, d)), min_count=10)
    return filtering.with_muted(hits, filtering.muted(found, rules))


SWAPS = scrub.read_swaps("example.com=corp.invalid, mail2.example.com=post.invalid"), scrub.read_swaps("233=10.9, 114.203=172.16.3", prefixes=True)


def _requests(spark, d):
    """Documents as the texts of one request for each language; each names domains in both cases and an address."""
    held = T.table(spark, d, "documents")
    shown = F.concat("text", F.lit(" see www.example.com or 233.1.2.3 and Mail2.Example.com, boss@mail2.example.com"))
    return held.select(F.col("lang").alias("request"), F.col("doc_id").alias("line_no"), shown.alias("text"))


@query
def scrub_tokens(spark, d):
    return scrub.scrubbed(_requests(spark, d), *SWAPS)[1]


@query
def scrubbed_texts(spark, d):
    return scrub.scrubbed(_requests(spark, d), *SWAPS, once=_stored(spark).once)[0]


@query
def restored_texts(spark, d):
    """What comes back of all texts; names of domains come back in lower case."""
    once = _stored(spark).once
    texts, tokens = scrub.scrubbed(_requests(spark, d), *SWAPS, once=once)
    return scrub.restored(once(texts), tokens, *SWAPS)


@query
def line_payloads(spark, d):
    """The collapsed lines in payloads of 250."""
    once = _stored(spark).once
    return payloads.packed(once(filtering.collapse(T.lines(spark, d), once)), payloads.LINES, "raw")


@query
def budget_payloads(spark, d):
    """Documents of each language packed by their characters, 2,000 to a payload; of the texts their numbers are shown."""
    held = T.table(spark, d, "documents").select("lang", F.col("doc_id").alias("line_no"), F.col("doc_id").cast("string").alias("name"), "n_chars")
    return payloads.within_budget(held, 2000, "name", F.col("n_chars"), "lang", separator=",")


@query
def anomaly_payloads(spark, d):
    found = detect.peer_anomalies(detect.pair_totals(T.counts(spark, d)), min_count=10)
    rank = F.row_number().over(Window.orderBy(F.round("score", 6).desc(), "host", "program"))  # a row for each anomaly, few
    said = found.withColumns({"line_no": rank, "os_family": F.lit("unix"), "headline": F.lit(B.PEER_HEADLINE), "summary": B.peer_summary(F.col("n"), F.col("median"))})
    said = said.join(detect.first_examples(T.parsed(spark, d)), ["host", "program"], "left")
    return payloads.packed(payloads.anomaly_lines(said), payloads.ANOMALIES, "line")


@query
def issue_payloads(spark, d):
    """The week's issues as lists of JSON objects, twelve to a payload, most severe first."""
    held = digest.within(T.findings(spark, d), *PERIOD).where("kind = 'issue'").withColumn("line_no", F.col("id") + F.lit(1 << 32) * L.severity_rank(F.col("severity")))
    made = payloads.issue_json(held, ["id", "title", "severity", "service"])
    return payloads.packed(made, payloads.ISSUES, "json", separator=",\n").select("payload", "n", F.concat(F.lit("[\n"), F.col("text"), F.lit("\n]")).alias("text"))


#: A rule for each host and even k, and as many that no line fits.
MANY_RULES = [filtering.Rule(100 * h + k + 1, f"host{h}", match=rf'"k": {k}\}}') for h in range(20) for k in range(0, 100, 2)]
MANY_RULES += [filtering.Rule(10_000 + k, match=rf"(?i)never (seen|met) {k}\b") for k in range(1000)]


@query
def many_rules(spark, d):
    tagged = filtering.with_rule(T.lines(spark, d), MANY_RULES)
    return tagged.select("line_no", "rule_id")


@query
def many_normalised(spark, d):
    """Lines said anew by the first of 600 patterns."""
    table = [(rf'view\[\d+\]: .*"k": {k}\}}', f"view {k}") for k in range(0, 100, 3)] + [(rf"never {k} met", "never") for k in range(500)] + [(r"error\[", "an error")] * 70
    return filtering.normalise(T.lines(spark, d), table).select("line_no", "raw")


@query
def digest_filed(spark, d):
    """All findings as daily runs of a month each, and what the digest over them files."""
    store = _stored(spark)
    rows = _yearly(spark, d, "month")
    months = [r.log_date for r in T.findings(spark, d).select(F.trunc("log_date", "month").alias("log_date")).distinct().collect()]
    store.capture_days(rows, {day: (None, None) for day in months}, "daily")
    made = reports.write_digest(store, min(months), max(months))
    said = F.from_json("payload", "n_days long, latest_id long")
    return made.findings.select("pos", "finding_kind", "severity", "service", F.array_join("hosts", ",").alias("hosts"), said["n_days"].alias("n_days"), said["latest_id"].alias("latest_id"))


@query
def compact_numbers(spark, d):
    """Account balances over a wide range, in six digits."""
    n = F.col("l_extendedprice").cast("double") * F.pow(F.lit(10.0), (F.col("l_linenumber") * 3 - 12).cast("double"))
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", B.compact(n).alias("shown"))


@query
def period_labels(spark, d):
    """Each customer's first and last order as labels."""
    spans = T.table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"), F.count("*").alias("n"))
    left = F.when(F.col("n") % 3 != 0, F.floor(F.col("n") / 3))
    return spans.select("o_custkey", B.period(F.col("a"), F.col("b")).alias("period"), B.short_day(F.col("a")).alias("short"), B.plain_day(F.col("b")).alias("plain"), B.reduction(F.col("n"), left).alias("reduction"))


@query
def document_secrets(spark, d):
    """All documents as they may be shown; some hold keys and passwords."""
    return T.table(spark, d, "documents").select("doc_id", L.mask_secrets(F.col("text")).alias("shown"))
