"""Counts as a stream: 10-minute windows with a watermark, written by day, or whole days worked out anew."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.lines import parse
from ..operators import detect
from ..sources.store import Store


def window_counts(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """(start, host, program, n) of a stream with (ts, host, program); later rows are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "host", "program").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "host", "program", "n")


def write_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to Parquet by day, as far as there is input; each batch is written once."""
    dated = counts.withColumn("log_date", F.to_date("start"))
    return dated.writeStream.format("parquet").partitionBy("log_date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replace_days(arrivals: DataFrame, whole: Callable[[list[datetime.date]], DataFrame], store: Store, checkpoint: str, name: str = "days") -> StreamingQuery:
    """Work out the counts of every day that a stream touches anew and replace them, as far as there is input.

    ``arrivals``: a stream with ``log_date``; ``whole(days)``: all lines (line_no, raw, log_date)
    of days as they are now. A late line or a file that comes again so gives what a batch over all of it
    gives, and a batch that is done twice changes nothing. Lines of other days that ``whole`` returns are left out. The
    days of a batch are replaced in one step, which notes the batch in the mark ``stream:name``.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        days = sorted(r.log_date for r in df.where("log_date IS NOT NULL").select("log_date").distinct().collect())
        if days:
            lines = whole(days).where(F.col("log_date").isin(days))
            store.replace_days(detect.window_counts(parse(lines), "log_date"), days, {f"stream:{name}": batch_id})

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
