"""Anomaly detectors: against peers, a series' own history, and its history at that time of day."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("host", "program")


def window_counts(parsed: DataFrame, *more: str) -> DataFrame:
    """(host, program, bucket, *more, n) of the lines that parsed."""
    return parsed.where("program IS NOT NULL").groupBy(*KEYS, "bucket", *more).agg(F.count("*").alias("n"))


def pair_totals(counts: DataFrame, *more: str) -> DataFrame:
    return counts.groupBy(*KEYS, *more).agg(F.sum("n").alias("n"))


def host_programs(counts: DataFrame) -> DataFrame:
    return counts.groupBy("host").agg(F.array_sort(F.collect_set("program")).alias("programs"))


def first_examples(parsed: DataFrame) -> DataFrame:
    """The first line of each host and program."""
    return parsed.where("program IS NOT NULL").groupBy(*KEYS).agg(F.min(F.struct("line_no", "raw")).alias("f")).select(*KEYS, F.col("f.raw").alias("example"))


def robust_z(x: Column, median: Column, mad: Column, mean_ad: Column) -> Column:
    """Modified z-score; without spread around the median by the mean deviation, else 0."""
    return F.when(mad > 0, 0.6745 * (x - median) / mad).when(mean_ad > 0, (x - median) / (1.253 * mean_ad)).otherwise(F.lit(0.0))


def peer_scores(totals: DataFrame, *more: str) -> DataFrame:
    """Totals with their program's number of hosts and median, and the score against them; ``more`` keys keep days apart.

    Statistics are aggregates of a program, joined back: rows stay where they are. An exact median
    holds a program's different totals with their counts in one task, at most a number a host.
    """
    keys = ["program", *more]
    middle = totals.groupBy(*keys).agg(F.median("n").alias("median"), F.count("*").alias("peers"))
    each = totals.join(middle, keys)
    off = F.abs(F.col("n") - F.col("median"))
    apart = each.groupBy(*keys).agg(F.median(off).alias("mad"), F.avg(off).alias("mean_ad"))
    scored = each.join(apart, keys)
    return scored.withColumn("score", robust_z(F.col("n"), F.col("median"), F.col("mad"), F.col("mean_ad"))).drop("mad", "mean_ad")


def peer_anomalies(totals: DataFrame, min_hosts: int = 5, min_count: int = 50, more: tuple[str, ...] = ()) -> DataFrame:
    return peer_scores(totals, *more).where((F.col("peers") >= min_hosts) & (F.col("n") >= min_count) & (F.col("score") > 0))


def median_of(values: Column) -> Column:
    """The median of a non-empty array."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda k: F.element_at(ordered, k.cast("int"))
    return F.when(n > 0, (at(F.greatest(F.lit(1), F.floor((n + 1) / 2))) + at(F.greatest(F.lit(1), F.floor(n / 2) + 1))) / 2)


def _history(counts: DataFrame, day: datetime.date, lookback: int, keys: tuple[str, ...]) -> DataFrame:
    """Days seen and the robust statistics of each series' totals on the ``lookback`` days before ``day``.

    Days without lines are no zeros. A series has at most ``lookback`` values.
    """
    first = day - datetime.timedelta(days=lookback)
    past = counts.where((F.col("log_date") >= F.lit(first)) & (F.col("log_date") < F.lit(day))).groupBy(*keys, "log_date").agg(F.sum("n").alias("n"))
    series = past.groupBy(*keys).agg(F.collect_list(F.col("n").cast("double")).alias("v"), F.count("*").alias("days_seen"))
    return _spread(series).select(*keys, "days_seen", "median", "mad", "mean_ad")


def _spread(series: DataFrame) -> DataFrame:
    """``series`` with the median of its values ``v``, and the median and mean of their distances from it."""
    series = series.withColumn("median", median_of(F.col("v")))
    series = series.withColumn("d", F.transform("v", lambda x: F.abs(x - F.col("median"))))
    mean = F.aggregate(F.array_sort("d"), F.lit(0.0), lambda a, x: a + x) / F.size("d")
    return series.withColumns({"mad": median_of(F.col("d")), "mean_ad": mean}).drop("d")


def baseline_scores(counts: DataFrame, day: datetime.date, lookback: int = 14, min_days: int = 7) -> DataFrame:
    """Each series' total today against its own days; a series without lines today has 0."""
    today = counts.where(F.col("log_date") == F.lit(day)).groupBy(*KEYS).agg(F.sum("n").alias("today"))
    both = _history(counts, day, lookback, KEYS).join(today, list(KEYS), "full").where(F.col("days_seen") >= min_days)
    both = both.withColumn("today", F.coalesce("today", F.lit(0)))
    score = robust_z(F.col("today"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return both.select(*KEYS, "today", "days_seen", "median", score.alias("score"))


def baseline_anomalies(scores: DataFrame, min_baseline: float = 50, min_silent: float = 100, threshold: float = 3.5) -> DataFrame:
    silent = (F.col("today") == 0) & (F.col("median") >= min_silent)
    odd = (F.col("median") >= min_baseline) & (F.abs("score") >= threshold)
    kind = F.when(silent, "silent").when(F.col("score") > 0, "louder").otherwise("quieter")
    return scores.where(silent | odd).withColumn("direction", kind)


def temporal_scores(counts: DataFrame, day: datetime.date, lookback: int = 14, min_days: int = 7) -> DataFrame:
    """Each series' count in a bucket today against the same bucket on its days before."""
    keys = (*KEYS, "bucket")
    today = counts.where(F.col("log_date") == F.lit(day)).groupBy(*keys).agg(F.sum("n").alias("today"))
    both = today.join(_history(counts, day, lookback, keys), list(keys)).where(F.col("days_seen") >= min_days)
    score = robust_z(F.col("today"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return both.select(*keys, "today", "days_seen", "median", score.alias("score"))


def temporal_anomalies(scores: DataFrame, min_count: int = 30, threshold: float = 3.5) -> DataFrame:
    return scores.where((F.col("today") >= min_count) & (F.col("score") >= threshold))


def combine(peer: DataFrame, baseline: DataFrame, temporal: DataFrame, *more: str) -> DataFrame:
    """The strongest anomaly of each host and program (and ``more`` keys); ties go to peers, then baselines, then times of day."""
    keys = (*KEYS, *more)
    lists = [
        peer.select(*keys, F.lit("peer").alias("kind"), F.lit(0).alias("_o"), F.lit("").alias("bucket"), "score"),
        baseline.select(*keys, F.lit("baseline").alias("kind"), F.lit(1).alias("_o"), F.lit("").alias("bucket"), "score"),
        temporal.select(*keys, F.lit("temporal").alias("kind"), F.lit(2).alias("_o"), "bucket", "score"),
    ]
    every = lists[0].unionByName(lists[1]).unionByName(lists[2])
    order = Window.partitionBy(*keys).orderBy(F.abs("score").desc(), "_o", F.desc("score"), "bucket")
    return every.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_o")


def ranked(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(F.abs("score").desc(), "host", "program")


def trailing_baselines(counts: DataFrame, lookback: int = 14) -> DataFrame:
    """(host, program, log_date, n, days_seen, median) of every day against the days before it, in one pass."""
    daily = pair_totals(counts, "log_date").withColumn("d", F.datediff("log_date", F.lit("1970-01-01")))
    frame = Window.partitionBy(*KEYS).orderBy("d").rangeBetween(-lookback, -1)
    held = daily.withColumn("v", F.collect_list(F.col("n").cast("double")).over(frame))
    return held.select(*KEYS, "log_date", "n", F.size("v").alias("days_seen"), median_of(F.col("v")).alias("median"))


def _trailing(daily: DataFrame, keys: tuple[str, ...], lookback: int) -> DataFrame:
    """Rows (keys, log_date, n) with days seen and the robust statistics of the ``lookback`` days before each; n may be null, which is no value."""
    frame = Window.partitionBy(*keys).orderBy(F.datediff("log_date", F.lit("1970-01-01"))).rangeBetween(-lookback, -1)
    held = daily.withColumn("v", F.collect_list(F.col("n").cast("double")).over(frame))
    return _spread(held.withColumn("days_seen", F.size("v").cast("long"))).drop("v")


def range_baseline_scores(counts: DataFrame, days: list[datetime.date], lookback: int = 14, min_days: int = 7) -> DataFrame:
    """``baseline_scores`` of every day of ``days`` in one plan, with ``log_date``.

    A series gets a row for each of the days, so that its silence shows; statistics come from a range
    frame of at most ``lookback`` values, whatever the number of days is.
    """
    near = counts.where(F.col("log_date").between(F.lit(min(days) - datetime.timedelta(days=lookback)), F.lit(max(days))))
    totals = pair_totals(near, "log_date")
    # a series from its first day on until its last can be of a day's history
    spans = totals.groupBy(*KEYS).agg(F.min("log_date").alias("first"), F.max("log_date").alias("last"))
    asked = spans.withColumn("log_date", F.explode(F.array(*map(F.lit, sorted(days)))))
    asked = asked.where((F.col("log_date") > F.col("first")) & (F.datediff("log_date", "last") <= lookback)).select(*KEYS, "log_date", F.lit(True).alias("asked"))
    both = _trailing(totals.join(asked, [*KEYS, "log_date"], "full"), KEYS, lookback).where((F.col("days_seen") >= min_days) & F.col("asked"))
    both = both.withColumn("today", F.coalesce("n", F.lit(0)))
    score = robust_z(F.col("today"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return both.select(*KEYS, "log_date", "today", "days_seen", "median", "mad", score.alias("score"))


def range_temporal_scores(counts: DataFrame, days: list[datetime.date], lookback: int = 14, min_days: int = 7) -> DataFrame:
    """``temporal_scores`` of every day of ``days`` in one plan, with ``log_date``."""
    keys = (*KEYS, "bucket")
    near = counts.where(F.col("log_date").between(F.lit(min(days) - datetime.timedelta(days=lookback)), F.lit(max(days))))
    daily = near.groupBy(*keys, "log_date").agg(F.sum("n").alias("n"))
    both = _trailing(daily, keys, lookback).where((F.col("days_seen") >= min_days) & F.col("log_date").isin(days))
    score = robust_z(F.col("n"), F.col("median"), F.col("mad"), F.col("mean_ad"))
    return both.select(*keys, "log_date", F.col("n").alias("today"), "days_seen", "median", "mad", score.alias("score"))
