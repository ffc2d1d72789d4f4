"""The engine's inputs made from the driver's tables: syslog lines, messages and a findings library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import parse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, raw, log_date): events as syslog lines."""
    ts = F.col("ts")
    stamp = F.concat(F.date_format(ts, "MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss "))
    host = F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string"))
    raw = F.concat(stamp, host, F.lit(" "), F.col("event_type"), F.lit("["), F.col("event_id").cast("string"), F.lit("]: "), F.col("props"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), raw.alias("raw"), F.to_date(ts).alias("log_date"))


def parsed(spark: SparkSession, sf_dir: str, minutes: int = 10) -> DataFrame:
    return parse(lines(spark, sf_dir), minutes=minutes)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, program, bucket, log_date, n), buckets of ten minutes."""
    from ..operators.detect import window_counts

    return window_counts(parsed(spark, sf_dir), "log_date")


def quarter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in buckets of six hours, coarse enough for small tables."""
    six = F.lpad((F.floor(F.substring("bucket", 1, 2).cast("int") / 6) * 6).cast("string"), 2, "0")
    own = counts(spark, sf_dir).withColumn("bucket", F.concat(six, F.lit(":00")))
    return own.groupBy("host", "program", "bucket", "log_date").agg(F.sum("n").alias("n"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings."""
    p = F.col("o_orderpriority")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long").alias("run_id"), day.alias("log_date"),
        F.when(F.col("o_orderstatus") == "P", "peer").otherwise("issue").alias("kind"), severity.alias("severity"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("svc"), (F.col("o_custkey") % 5).cast("string")).alias("service"),
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(finding_id, host, pos): suppliers as hosts."""
    host = F.concat(F.lit("host"), (F.col("l_suppkey") % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id"), host.alias("host")).agg(F.min("l_linenumber").alias("pos"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as votes, the latest of each finding and user."""
    own = table(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')")
    last = own.groupBy(F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").cast("long").alias("user_id")).agg(
        F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")).alias("l")
    )
    return last.select("finding_id", "user_id", F.when(F.col("l.l_returnflag") == "A", "worked").otherwise("didnt_work").alias("verdict"), F.lit("").alias("comment"), F.col("l.l_shipdate").alias("created_at"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each day with findings; every third has no recorded volume."""
    each = findings(spark, sf_dir).groupBy("run_id", "log_date").agg(F.count("*").alias("n"))
    return each.select("run_id", "log_date", F.when(F.col("run_id") % 3 != 0, F.col("n") * 100).alias("raw_lines"), F.when(F.col("run_id") % 3 != 0, F.col("n")).alias("filtered_lines"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, os): what operators say of hosts with a number above nine."""
    host = F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string"))
    return table(spark, sf_dir, "events").select(host.alias("host")).distinct().where("length(host) = 6").withColumn("os", F.lit("debian"))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, program, explanation) of programs named error."""
    host = F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string"))
    pairs = table(spark, sf_dir, "events").where("event_type = 'error'").select(host.alias("host"), F.col("event_type").alias("program")).distinct()
    return pairs.withColumn("explanation", F.concat(F.lit("errors of "), F.col("host")))
