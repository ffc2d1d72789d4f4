"""The weekly digest and the management report, each in one call over the store.

Tables are made by Spark; what a report shows of them is a bounded number of rows, which the driver
reads to write the notices and the text.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as B
from ..operators import digest, facts, mgmt
from ..sources.store import Store
from ..sources.versions import Files

#: Issues and anomalies that a digest shows at most (fixed values).
ISSUES, ONE_OFFS, ANOMALIES = 10, 5, 15
#: Notices of a digest.
COVERS = "Covers {} daily run{}."
NO_RUN = " No run was recorded for {}."
BUDGET = "**Token budget reached on {}.** The run asked the model no more once the day's budget was spent, so its findings are incomplete; something unusual may be flooding the logs."


@dataclass
class Digest:
    """A digest: its filed findings with ids, and its days."""

    findings: DataFrame
    run_days: list[datetime.date]
    missing: list[datetime.date]
    budget_days: list[datetime.date] = field(default_factory=list)

    def notices(self) -> list[str]:
        """What stands under the title: spent budgets, then how many runs it covers and which days have none."""
        said = [BUDGET.format(", ".join(map(day_label, self.budget_days)))] if self.budget_days else []
        covers = COVERS.format(len(self.run_days), "" if len(self.run_days) == 1 else "s")
        return [*said, covers + (NO_RUN.format(", ".join(map(day_label, self.missing))) if self.missing else "")]


def day_label(day: datetime.date) -> str:
    return f"{day:%a} {day.day} {day:%b}"


def write_digest(
    store: Store, first: datetime.date, last: datetime.date, *, clusters: DataFrame | None = None, issues: int = ISSUES, one_offs: int = ONE_OFFS, anomalies: int = ANOMALIES
) -> Digest:
    """Group the daily runs' findings of a window and file the digest as a run of its last day.

    Filed are the recurring issues in rank order, after them severe ones of a single day, then
    anomalies by days, host and program. Titles are made unique among the issues. An earlier digest of that
    day is replaced. A window without runs files a digest without findings.
    """
    runs = store.runs(first, last, "daily")
    told = runs.select("log_date", "over_budget").collect()  # a row per day
    run_days = sorted({r.log_date for r in told})
    found = store.findings(first, last, "daily").drop("kind").withColumnRenamed("finding_kind", "kind")
    hosts = store.hosts()
    groups = store.once(facts.unique_titles(digest.issue_groups(found, hosts, clusters)))
    often = digest.recurring(groups, len(run_days), issues).withColumn("section", F.lit(0))
    once = digest.one_offs(groups, len(run_days), one_offs).join(often.select("latest_id"), "latest_id", "left_anti").withColumn("section", F.lit(1))
    odd = rank_anomalies(digest.anomaly_groups(found, hosts)).limit(anomalies)
    filed = often.unionByName(once).select(
        "section", F.struct(F.when(F.col("section") == 0, -F.col("n_days")).otherwise(0).alias("a"), "rank", F.when(F.col("section") == 0, 0).otherwise(-F.col("n_hosts")).alias("b"), "service", "hosts", "latest_id").alias("o"),
        F.lit("issue").alias("finding_kind"), "severity", F.col("unique_title").alias("title"), "service", F.when(F.col("hosts") != "", F.split("hosts", ",")).otherwise(F.array().cast("array<string>")).alias("hosts"),
        F.to_json(F.struct("n_days", "latest_id")).alias("payload"),
    )
    rows = filed.collect()  # as many as a digest shows
    rows = [r[2:] for r in sorted(rows, key=lambda r: (r[0], tuple(r[1])))]
    for r in odd.collect():
        rows.append((r.kinds.split(",")[0], "", f"{r.program} on {r.host}", r.program, [r.host], f'{{"n_days":{r.n_days},"latest_id":{r.latest_id}}}'))
    schema = "finding_kind string, severity string, title string, service string, hosts array<string>, payload string, pos long"
    stored = store.capture(store.spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema), last, "digest")
    missing = [r.day for r in digest.missing_days(runs, str(first), str(last)).orderBy("day").collect()]
    return Digest(stored, run_days, missing, sorted({r.log_date for r in told if r.over_budget}))


def rank_anomalies(groups: DataFrame) -> DataFrame:
    """Anomalies of the most days first, then by host and program."""
    return groups.orderBy(F.desc("n_days"), "host", "program")


def digest_text(made: Digest, title: str) -> str:
    """The digest as Markdown: notices, issues with their hosts and days, anomalies."""
    rows = made.findings.withColumn("p", F.from_json("payload", "n_days long, latest_id long")).orderBy("id").collect()
    out = [f"# {title}", *made.notices()]
    for r in rows:
        where = ", ".join(r.hosts[:5]) + (f" and {len(r.hosts) - 5} more" if len(r.hosts) > 5 else "")
        head = f"## {r.title}" if r.finding_kind == "issue" else f"- {r.title}"
        out.append(f"{head} (#{r.id}): {(r.severity + ', ') if r.severity else ''}{r.p.n_days} of {len(made.run_days)} days" + (f", {where}" if where else ""))
    return "\n\n".join(out) + "\n"


def management(store: Store, first: datetime.date, last: datetime.date) -> dict[str, DataFrame]:
    """The tables of the management report of a period, by name."""
    a, b, span = str(first), str(last), (last - first).days + 1
    runs, counts, hosts = store.runs(first, last), store.counts(first, last), store.hosts()
    found = store.findings(first, last, "daily").drop("kind").withColumnRenamed("finding_kind", "kind")
    rows = mgmt.day_rows(runs, counts, found, a, b)
    return {
        "days": rows.orderBy("day"), "totals": mgmt.totals(rows), "severities": mgmt.by_severity(found), "services": mgmt.top_services(found), "verdicts": mgmt.votes_by_verdict(store.votes(), found),
        "flagged": mgmt.flagged_hosts(found, hosts), "noisiest": mgmt.noisiest_hosts(counts, a, b), "median": mgmt.median_per_host(counts, a, b),
        "movers": mgmt.movers(counts, a, b, span), "reporting": mgmt.hosts_reporting(counts, a, b, span),
    }


def management_text(tables: dict[str, DataFrame], first: datetime.date, last: datetime.date) -> str:
    """The report as Markdown: a headline, and a table for each of its tables that has rows."""
    label = tables["totals"].select(B.period(F.lit(first), F.lit(last)).alias("p")).first().p
    out = [f"# {label}"]
    for name, table in tables.items():
        rows = table.collect()  # a row per day, or as many as the table's limit
        if rows:
            out.append("\n".join([f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|---" * len(table.columns) + "|", *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]))
    return "\n\n".join(out) + "\n"


def write_file(store: Store, name: str, text: str) -> str:
    """Write a report beside the tables, in place of one of that name once it is whole; returns its path."""
    files = Files(store.spark, f"{store.folder}/reports")
    files.replace(text, name)
    return f"{files.folder}/{name}"
