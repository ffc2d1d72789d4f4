"""The management report: volumes, findings, hosts and movers of a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digest import days, within

WEEK = 7


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def daily(runs: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daily runs and their findings; runs without ``kind`` are all daily."""
    if "kind" not in runs.columns:
        return runs, findings
    own = runs.where("kind = 'daily'")
    return own, findings.join(own.select("run_id"), "run_id", "left_semi")


def day_rows(runs: DataFrame, counts: DataFrame, findings: DataFrame, first: str, last: str) -> DataFrame:
    """Each day of the period with its volume (the run's, else the lines counted) and findings: one row a day.

    Only daily runs and their findings count; of several daily runs of a day that with the
    largest id does.
    """
    spine = days(runs.sparkSession, first, last)
    runs, findings = daily(runs, findings)
    raw = runs.groupBy(F.col("log_date").alias("day")).agg(F.max(F.struct("run_id", "raw_lines", "filtered_lines")).alias("r"))
    raw = raw.select("day", "r.raw_lines", "r.filtered_lines")
    volume = counts.groupBy(F.col("log_date").alias("day")).agg(F.sum("n").alias("counted"))
    found = findings.groupBy(F.col("log_date").alias("day")).agg(F.count("*").alias("n_findings"))
    joined = spine.join(raw, "day", "left").join(volume, "day", "left").join(found, "day", "left")
    return joined.select(
        "day", F.coalesce("raw_lines", "counted").alias("volume"), (F.col("raw_lines").isNull() & F.col("counted").isNotNull()).alias("approximate"),
        "filtered_lines", F.coalesce("n_findings", F.lit(0)).alias("n_findings"),
    )


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("volume").alias("days_with_data"), F.count_if("approximate").alias("approximate_days"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        F.coalesce(F.sum("filtered_lines"), F.lit(0)).alias("filtered"), (F.count("filtered_lines") > 0).alias("have_filtered"), F.sum("n_findings").alias("n_findings"),
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """Issues by severity, anomalies together."""
    label = F.when(F.col("kind") == "issue", F.lower("severity")).otherwise("anomaly")
    return findings.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def top_services(findings: DataFrame, limit: int = 5) -> DataFrame:
    return findings.where("service != ''").groupBy("service").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service").limit(limit)


def votes_by_verdict(votes: DataFrame, findings: DataFrame) -> DataFrame:
    return votes.join(findings.select(F.col("id").alias("finding_id")), "finding_id").groupBy("verdict").agg(F.count("*").alias("n"))


def flagged_hosts(findings: DataFrame, hosts: DataFrame, limit: int = 5) -> DataFrame:
    """Hosts by the days and findings that name them."""
    joined = findings.join(hosts, F.col("id") == F.col("finding_id"))
    each = joined.groupBy("host").agg(F.count_distinct("log_date").alias("n_days"), F.count_distinct("id").alias("n_findings"))
    return each.orderBy(F.desc("n_days"), F.desc("n_findings"), "host").limit(limit)


def hosts_reporting(counts: DataFrame, first: str, last: str, n_days: int) -> DataFrame:
    """Distinct hosts in the period's last week (or less), and in the same days one period earlier."""
    span = min(WEEK, n_days)
    day = F.col("log_date")
    now = day.between(F.date_sub(_day(last), span - 1), _day(last))
    before = day.between(F.date_sub(_day(last), span - 1 + n_days), F.date_sub(_day(last), n_days))
    return counts.where(now | before).agg(F.count_distinct(F.when(now, F.col("host"))).alias("hosts_now"), F.count_distinct(F.when(before, F.col("host"))).alias("hosts_before"))


def noisiest_hosts(counts: DataFrame, first: str, last: str, limit: int = 5) -> DataFrame:
    """Hosts by lines a day over the days that have any, with their top program and its share."""
    own = within(counts, first, last)
    n_days = own.agg(F.count_distinct("log_date").alias("n_days"))
    programs = own.groupBy("host", "program").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("host").orderBy(F.desc("n"), "program")
    top = programs.withColumn("k", F.row_number().over(order)).where("k = 1").select("host", F.col("program").alias("top_program"), F.col("n").alias("top_n"))
    each = programs.groupBy("host").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "host").limit(limit)
    # one row
    each = each.join(top, "host").join(F.broadcast(n_days))
    return each.select("host", "n", (F.col("n") / F.col("n_days")).alias("per_day"), "top_program", (F.col("top_n") / F.col("n")).alias("share"))


def median_per_host(counts: DataFrame, first: str, last: str) -> DataFrame:
    """The median over hosts of lines a day; a host absent on a day with data has none that day."""
    own = within(counts, first, last)
    n_days = own.agg(F.count_distinct("log_date").alias("n_days"))
    each = own.groupBy("host").agg(F.sum("n").alias("n"))
    return each.agg(F.median("n").alias("m"), F.count("*").alias("hosts")).join(F.broadcast(n_days)).select((F.col("m") / F.col("n_days")).alias("median_per_day"), "hosts")


def movers(counts: DataFrame, first: str, last: str, n_days: int, floor: float = 1000, limit: int = 5) -> DataFrame:
    """Hosts whose lines a day changed most from the period's first days to its last."""
    span = min(WEEK, n_days // 2)
    day = F.col("log_date")
    early, late = day < F.date_add(_day(first), span), day > F.date_sub(_day(last), span)
    own = within(counts, first, last)
    seen = own.agg(F.count_distinct(F.when(early, day)).alias("d0"), F.count_distinct(F.when(late, day)).alias("d1"))
    each = own.groupBy("host").agg(F.coalesce(F.sum(F.when(early, F.col("n"))), F.lit(0)).alias("s0"), F.coalesce(F.sum(F.when(late, F.col("n"))), F.lit(0)).alias("s1"))
    both = each.join(F.broadcast(seen)).where("d0 > 0 AND d1 > 0").select("host", (F.col("s0") / F.col("d0")).alias("before"), (F.col("s1") / F.col("d1")).alias("after"))
    far = F.when((F.col("before") == 0) | (F.col("after") == 0), F.lit(float("inf"))).otherwise(F.abs(F.log(F.col("after") / F.col("before"))))
    most = F.greatest("before", "after")
    moved = both.where((most >= floor) & (F.col("before") != F.col("after")))
    return moved.orderBy(far.desc(), most.desc(), "host").limit(limit)
