"""The findings library: search, pages, counts, votes and totals.

Findings have (id, run_id, log_date, kind, severity, title, service, payload); hosts are rows of
(finding_id, pos, host); votes are rows of (finding_id, user_id, verdict, comment, created_at).
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _low(text: Column) -> Column:
    """``text`` with A-Z in lower case, and no other letter changed."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _holds(column: str, text: str) -> Column:
    return F.contains(_low(F.col(column)), _low(F.lit(text)))


def search(
    findings: DataFrame, hosts: DataFrame, *, host: str = "", service: str = "", title: str = "", severity: str = "", kind: str = "",
    first: str = "", last: str = "", runs: DataFrame | None = None, run_kind: str = "",
) -> DataFrame:
    """Findings that fit every filter given; texts by substring without regard to case, days inclusive.

    ``run_kind`` is daily or digest, by the run's row in ``runs`` (run_id, kind).
    """
    if run_kind not in ("", "daily", "digest"):
        raise ValueError("a run is daily or digest")
    out = findings
    if run_kind:
        out = out.join(runs.where(F.col("kind") == run_kind).select("run_id"), "run_id", "left_semi")
    for column, text in (("service", service), ("title", title)):
        out = out.where(_holds(column, text)) if text else out
    for column, text in (("severity", severity), ("kind", kind)):
        out = out.where(F.col(column) == text) if text else out
    out = out.where(F.col("log_date") >= F.lit(first).cast("date")) if first else out
    out = out.where(F.col("log_date") <= F.lit(last).cast("date")) if last else out
    if host:
        out = out.join(hosts.where(_holds("host", host)), F.col("id") == F.col("finding_id"), "left_semi")
    return out


def page(found: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest day first, then by id."""
    return found.orderBy(F.desc("log_date"), "id").offset(offset).limit(limit)


def host_lists(hosts: DataFrame) -> DataFrame:
    """(finding_id, hosts): each finding's hosts in the order they were added."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "host")))
    return hosts.groupBy("finding_id").agg(F.array_join(F.transform(pairs, lambda p: p["host"]), ",").alias("hosts"))


def run_summary(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs with how many findings they have."""
    counts = findings.groupBy("run_id").agg(F.count("*").alias("n_findings"))
    return runs.join(counts, "run_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0)))


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("finding_id").agg(F.count_if(F.col("verdict") == "worked").alias("worked"), F.count_if(F.col("verdict") == "didnt_work").alias("didnt_work"))


def with_votes(findings: DataFrame, votes: DataFrame) -> DataFrame:
    joined = findings.join(vote_counts(votes), F.col("id") == F.col("finding_id"), "left").drop("finding_id")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("worked", "didnt_work")})


def merge_votes(votes: DataFrame, new: DataFrame) -> DataFrame:
    """Votes after ``new`` ones: one per finding and user, its verdict the latest; a null user is the anonymous one.

    The comment is the latest that isn't empty, as if the votes came in one by one.
    """
    keys = ["finding_id", "user_id"]
    latest = new.groupBy(*keys).agg(
        F.max(F.struct("created_at", "verdict")).alias("n"),
        F.max(F.when(F.col("comment") != "", F.struct("created_at", "verdict", "comment"))).alias("said"),
    )
    old, now = votes.select(*keys, "verdict", "comment", "created_at").alias("old"), latest.alias("now")
    both = old.join(now, (F.col("old.finding_id") == F.col("now.finding_id")) & F.col("old.user_id").eqNullSafe(F.col("now.user_id")), "full")
    seen = F.col("now.n").isNotNull()
    return both.select(
        F.coalesce("now.finding_id", "old.finding_id").alias("finding_id"), F.when(seen, F.col("now.user_id")).otherwise(F.col("old.user_id")).alias("user_id"),
        F.coalesce("now.n.verdict", "old.verdict").alias("verdict"), F.coalesce("now.said.comment", "old.comment", F.lit("")).alias("comment"),
        F.coalesce("now.n.created_at", "old.created_at").alias("created_at"),
    )


def daily_totals(counts: DataFrame, host: str = "", program: str = "") -> DataFrame:
    """(log_date, host, program, n) over all buckets."""
    for column, value in (("host", host), ("program", program)):
        counts = counts.where(F.col(column) == value) if value else counts
    return counts.groupBy("log_date", "host", "program").agg(F.sum("n").alias("n"))


def reassign_votes(votes: DataFrame, user_id: int) -> DataFrame:
    """Votes after a user is removed: theirs become anonymous, but where an anonymous one is there."""
    theirs = votes.where(F.col("user_id") == user_id)
    anonymous = votes.where(F.col("user_id").isNull())
    moved = theirs.join(anonymous.select("finding_id"), "finding_id", "left_anti").withColumn("user_id", F.lit(None).cast("long"))
    return votes.where(~F.col("user_id").eqNullSafe(user_id)).unionByName(moved)


def feedback(votes: DataFrame, users: DataFrame) -> DataFrame:
    """Votes with their user's ``name``, empty if anonymous or unknown, newest first."""
    named = votes.join(users.select(F.col("id").alias("user_id"), "name"), "user_id", "left")
    return named.withColumn("name", F.coalesce("name", F.lit(""))).orderBy(F.desc("created_at"), "finding_id", "user_id")
