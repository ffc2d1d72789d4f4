"""Readers of line files and of dumped documents, as tables of numbered lines."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DOC = T.StructType([T.StructField(n, T.StringType()) for n in ("@timestamp", "host.name", "host.hostname", "host.os.name", "host.os.version", "process.name", "process.pid", "message")])


def numbered(rows: DataFrame) -> DataFrame:
    """``line_no`` from 1 within a file, from (file, block, id): counts of blocks, then places in them."""
    order = Window.partitionBy("file", "block").orderBy("id")
    placed = rows.withColumn("k", F.row_number().over(order))
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return placed.join(base, ["file", "block"]).withColumn("line_no", F.col("base") + F.col("k")).drop("base", "k", "id", "block")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, raw, line_no) of text files; only ``\\n`` ends a line."""
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    return numbered(rows)


def read_documents(spark: SparkSession, path: str | list[str], zone: str = "Europe/London") -> DataFrame:
    """(file, line_no, raw, log_date, host, os) of NDJSON dumps (gzip too), rendered as lines.

    Blank lines and documents without a time or message are left out; a line that is no JSON
    object fails the read. Times are shown in ``zone``.
    """
    rows = read_lines(spark, path).where(F.trim("raw") != "")
    bad = F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" is no JSON object")))
    doc = F.from_json("raw", _DOC)
    rows = rows.withColumn("keys", F.json_object_keys("raw")).withColumn("d", doc)
    get = lambda name: F.col("d").getField(name)
    given = lambda name, value, default: F.when(F.array_contains("keys", name), value).otherwise(F.lit(default))
    usable = (F.coalesce(get("@timestamp"), F.lit("")) != "") & (F.coalesce(get("message"), F.lit("")) != "")
    rows = rows.where(F.when(F.col("keys").isNull(), bad.cast("boolean")).otherwise(usable))
    when = F.from_utc_timestamp(F.to_utc_timestamp(F.to_timestamp(get("@timestamp")), F.current_timezone()), zone)
    host = F.coalesce(F.nullif(get("host.hostname"), F.lit("")), F.nullif(F.substring_index(get("host.name"), ".", 1), F.lit("")), F.lit("unknown"))
    program = given("process.name", F.coalesce(get("process.name"), F.lit("None")), "unknown")
    tag = F.concat(program, F.when(get("process.pid").isNotNull(), F.concat(F.lit("["), get("process.pid"), F.lit("]"))).otherwise(""), F.lit(":"))
    stamp = F.concat(F.date_format(when, "MMM "), F.lpad(F.dayofmonth(when).cast("string"), 2, " "), F.date_format(when, " HH:mm:ss"))
    raw = F.concat_ws(" ", stamp, host, tag, F.translate(get("message"), "\r\n", "  "))
    system = F.concat_ws(" ", get("host.os.name"), F.nullif(F.substring_index(get("host.os.version"), " ", 1), F.lit("")))
    return rows.select("file", "line_no", raw.alias("raw"), F.to_date(when).alias("log_date"), host.alias("host"), F.nullif(system, F.lit("")).alias("os"))


#: Fields of a document that are kept, in the order in which they are written.
KEPT = ["@timestamp", "host.name", "host.hostname", "host.os.name", "host.os.version", "host.os.family", "process.name", "process.pid", "message"]


def flattened(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """``rows`` with ``flat``: the nested document ``raw`` as one JSON object of KEPT's dotted keys, in that order.

    Fields that are null, missing or beneath something that is no object are left out; other
    values stay as they are, but that fractions lose zeros at their end. Text that is no JSON
    gives null.
    """
    rows = rows.withColumn("_v", F.try_parse_json(raw))
    parts = []
    for name in KEPT:
        value = F.try_variant_get("_v", "$" + "".join(f"['{step}']" for step in name.split(".")), "variant")
        parts.append(F.when(~F.is_variant_null(value), F.concat(F.lit(f'"{name}":'), F.to_json(value))))
    flat = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return rows.withColumn("flat", F.when(F.col("_v").isNotNull(), flat)).drop("_v")


def day_paths(spark: SparkSession, folder: str, last: datetime.date, days: int, suffix: str = ".ndjson.gz") -> tuple[list[str], list[datetime.date]]:
    """(paths, missing days) of the daily dumps up to ``last``; an empty file counts as missing."""
    jvm = spark._jvm
    found, missing = [], []
    for k in reversed(range(days)):
        day = last - datetime.timedelta(days=k)
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{day}{suffix}")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        there = fs.exists(where) and fs.getFileStatus(where).getLen() > 0
        (found if there else missing).append(str(where.toString()) if there else day)
    return found, missing
