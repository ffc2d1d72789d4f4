"""The digest of several days: groups of issues and anomalies, missing days, what recurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import severity_rank


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day): every day from first to last; none if they are the wrong way round."""
    span = F.when(F.lit(first).cast("date") <= F.lit(last).cast("date"), F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return spark.range(1).select(F.explode(span).alias("day"))


def within(findings: DataFrame, first: str, last: str) -> DataFrame:
    return findings.where(F.col("log_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def issue_groups(findings: DataFrame, hosts: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Issues grouped by service and hosts, or by their cluster where ``clusters`` (id, cluster) has one.

    (service, hosts, n_days, severity, rank, latest_id, title): hosts of all members, the worst
    severity, and the service and title of the latest by day and id.
    """
    issues = findings.where("kind = 'issue'")
    held = hosts.join(issues.select(F.col("id").alias("finding_id")), "finding_id", "left_semi").groupBy("finding_id").agg(F.array_sort(F.collect_set("host")).alias("h"))
    each = issues.join(held, F.col("id") == F.col("finding_id"), "left").withColumn("h", F.coalesce("h", F.array().cast("array<string>")))
    key = F.concat_ws("\0", F.coalesce("service", F.lit("")), F.array_join("h", "\0"))
    if clusters is not None:
        each = each.join(clusters.select(F.col("id").alias("_cid"), "cluster"), F.col("id") == F.col("_cid"), "left")
        key = F.coalesce(F.col("cluster").cast("string"), key)
    groups = each.groupBy(key.alias("key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("h")))).alias("h"), F.count_distinct("log_date").alias("n_days"),
        F.min(F.struct(severity_rank(F.col("severity")).alias("rank"), "severity")).alias("s"), F.max(F.struct("log_date", "id", "service", "title")).alias("l"),
    )
    return groups.select("l.service", F.array_join("h", ",").alias("hosts"), F.size("h").alias("n_hosts"), "n_days", "s.severity", "s.rank", F.col("l.id").alias("latest_id"), "l.title")


def rank_issues(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("n_days"), "rank", "service", "hosts", "latest_id")


def anomaly_groups(findings: DataFrame, hosts: DataFrame) -> DataFrame:
    """Anomalies grouped by host and program (their service): days, kinds, latest."""
    odd = findings.where("kind != 'issue'").join(hosts.select("finding_id", "host"), F.col("id") == F.col("finding_id"))
    groups = odd.groupBy("host", F.col("service").alias("program")).agg(
        F.count_distinct("log_date").alias("n_days"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.max(F.struct("log_date", "id")).alias("l")
    )
    return groups.select("host", "program", "n_days", "kinds", F.col("l.id").alias("latest_id"))


def missing_days(runs: DataFrame, first: str, last: str) -> DataFrame:
    """Days of the window without a run."""
    return days(runs.sparkSession, first, last).join(runs.select(F.col("log_date").alias("day")), "day", "left_anti")


def recurring(groups: DataFrame, run_days: int, limit: int = 10) -> DataFrame:
    return rank_issues(groups.where(F.col("n_days") >= min(2, run_days))).limit(limit)


def one_offs(groups: DataFrame, run_days: int, limit: int = 5) -> DataFrame:
    """Severe issues of a single day, the widest first; none when there are fewer than two days."""
    found = groups.where((F.col("n_days") == 1) & (F.col("rank") <= 1) & F.lit(run_days >= 2))
    return found.orderBy("rank", F.desc("n_hosts"), "service", "hosts", "latest_id").limit(limit)


def repair_clusters(proposed: DataFrame, known: DataFrame) -> DataFrame:
    """(id, cluster) of each known id from (cluster, id): unknown ids go, the first cluster wins, others stand alone."""
    first = proposed.join(known.select("id"), "id", "left_semi").groupBy("id").agg(F.min("cluster").alias("cluster"))

    # ids alone get negative numbers, which no proposed cluster has
    return known.select("id").join(first, "id", "left").select("id", F.coalesce("cluster", -1 - F.col("id")).alias("cluster"))
