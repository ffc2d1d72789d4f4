"""What is known of anomalies and issues: examples, systems, explanations, resolutions, titles.

Each is a left join by key, so a finding for which there is nothing stays with its own facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lines import severity_rank


def with_facts(anomalies: DataFrame, examples: DataFrame, families: DataFrame, inventory: DataFrame | None = None, *more: str) -> DataFrame:
    """Anomalies with ``example`` (empty without one) and ``os``; ``more`` keys, days say, keep examples and families apart.

    ``examples``: (host, program, example); ``families``: (host, os_family), unknown for hosts that
    are not there; ``inventory``: (host, os), what operators say, which counts before a family.
    """
    out = anomalies.join(examples, [*more, "host", "program"], "left").join(families, [*more, "host"], "left")
    family = F.coalesce("os_family", F.lit("unknown"))
    if inventory is None:
        return out.withColumns({"example": F.coalesce("example", F.lit("")), "os": family}).drop("os_family")
    out = out.join(inventory.select("host", "os"), "host", "left")
    return out.withColumns({"example": F.coalesce("example", F.lit("")), "os": F.coalesce("os", family)}).drop("os_family")


def explained(anomalies: DataFrame, explanations: DataFrame) -> DataFrame:
    """Anomalies with their ``explanation`` by host and program; null where facts alone are known."""
    return anomalies.join(explanations.select("host", "program", "explanation"), ["host", "program"], "left")


def resolved(issues: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Issues with the ``resolution`` of their very title; of several the last by ``pos`` counts.

    ``resolutions``: (pos, title, resolution).
    """
    last = resolutions.groupBy("title").agg(F.max_by("resolution", "pos").alias("resolution"))
    return issues.join(last, "title", "left")


def most_severe(issues: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The ``n`` most severe issues, in their own order among equals."""
    return issues.orderBy(severity_rank(F.col("severity")), order).limit(n)


def inventory_order(inventory: DataFrame) -> DataFrame:
    """Hosts in the order of their names without regard to case, then as they are."""
    return inventory.orderBy(F.lower("host"), "host")


def unique_titles(groups: DataFrame) -> DataFrame:
    """Ranked issue groups with ``unique_title``, which no other group has unless titles end in ``#2`` themselves.

    A title that several groups share gets its group's first host; what is still the same is
    numbered in the order of ``digest.rank_issues``. ``hosts`` is a list with commas.
    """
    first = F.substring_index("hosts", ",", 1)
    shared = groups.groupBy("title").agg(F.count("*").alias("_shared"))
    named = groups.join(shared, "title").withColumn("_base", F.when((F.col("_shared") > 1) & (first != ""), F.concat("title", F.lit(" ("), first, F.lit(")"))).otherwise(F.col("title")))
    place = F.row_number().over(Window.partitionBy("_base").orderBy(F.desc("n_days"), "rank", "service", "hosts", "latest_id"))
    told = named.withColumn("_place", place)
    return told.withColumn("unique_title", F.when(F.col("_place") > 1, F.concat("_base", F.lit(" #"), F.col("_place").cast("string"))).otherwise(F.col("_base"))).drop("_shared", "_base", "_place")
