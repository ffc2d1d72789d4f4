"""URL filters: listed rules, and association rules mined from labelled URLs.

Everything is DataFrame operations and Spark's FP-growth. A URL becomes a set of tokens (scheme,
host suffixes, path segments, query keys). FP-growth finds token combinations that are
frequent with the mark of bad pages; rules below the least support or confidence go, and so do
rules that a more general one of no less confidence covers. Pages meet the rules through an
inverted index on each rule's rarest token.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: (host, path, verdict): fits the host and its subdomains, on paths that start with the path.
LISTED = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A rule's least share of the labelled pages, its least number of bad ones, its least confidence.
SUPPORT, LEAST, CONFIDENCE = 0.001, 12, 0.6
_BAD = "bad page"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or a URL."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def suffixes(host: Column) -> Column:
    """The host and the domains it is under, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The token set of a URL; numbers in paths are one token."""
    scheme = F.concat(F.lit("scheme "), F.substring_index(F.coalesce(url, F.lit("")), "://", 1))
    hosts = F.transform(F.filter(suffixes(host), lambda x: x != ""), lambda x: F.concat(F.lit("host "), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path "), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query "), F.substring_index(x, "=", 1)))
    mark = F.when(F.coalesce(F.instr(url, "#") > 0, F.lit(False)), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(host != "", F.array(scheme)).otherwise(F.array().cast("array<string>")), hosts, segments, keys, mark))


def listed_rule(host: Column, path: Column, rules=LISTED) -> Column:
    """(n, rule, verdict) of the longest listed rule that fits, null if none does.

    The rules are written in the code and few, so they are one expression and no join.
    """
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    made = lambda h, p, v: F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
    return F.array_max(F.array(*[F.when(fits(h, p), made(h, p, v)) for h, p, v in rules]))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule_id, items, confidence, support, rarest) of the pruned rules from (items, bad) rows.

    No labelled rows, none bad, or no frequent combination: an empty table.
    """
    rows = labelled.where("bad IS NOT NULL").select(
        F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items")
    )
    rows = materialise(rows.where(F.size("items") > 0), "transactions")
    n = rows.count()
    if not n:
        return rows.select(F.lit(0).cast("long").alias("rule_id"), "items", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"), F.lit("").alias("rarest"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=confidence).fit(rows)
    found = model.associationRules.where(F.col("consequent")[0] == _BAD)
    found = found.select(F.array_sort("antecedent").alias("items"), "confidence", "support")
    found = materialise(found.withColumn("rule_id", F.xxhash64("items")), "rules")
    # a rule goes if fewer of its tokens do no worse
    general = found.select(F.col("items").alias("g"), F.col("confidence").alias("gc"), F.element_at("items", 1).alias("one"))
    parts = found.select("rule_id", "items", "confidence", F.explode("items").alias("one"))
    worse = parts.join(general, "one").where((F.size("g") < F.size("items")) & (F.col("gc") >= F.col("confidence")) & (F.size(F.array_except("g", "items")) == 0))
    kept = found.join(worse.select("rule_id").distinct(), "rule_id", "left_anti")
    often = rows.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rare = kept.select("rule_id", F.explode("items").alias("token")).join(often, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("m"))
    return materialise(kept.join(rare, "rule_id").select("rule_id", "items", "confidence", "support", F.col("m.token").alias("rarest")), "index")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, confidence, rule_items) of the best mined rule that each row of (row, items) holds."""
    index = rules.select(F.col("rarest").alias("token"), F.col("items").alias("needs"), "confidence")
    each = urls.select("row", "items", F.explode("items").alias("token")).join(index, "token")
    holds = each.where(F.size(F.array_except("needs", "items")) == 0)
    return holds.groupBy("row").agg(F.max(F.struct("confidence", "needs")).alias("m")).select("row", "m.confidence", F.col("m.needs").alias("mined"))


def judge(
    pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules=LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE,
) -> DataFrame:
    """(id_col, host, path, rule, verdict, confidence, mined): one row per row of ``pages``.

    ``labelled``: (url, bad) rows, bad 1 or 0 (null: left out). The longest listed rule that
    fits decides (``rule``, like ``net/es/``); else a page is blocked if it holds all
    tokens of a mined rule (``mined``, ``confidence``), and allowed otherwise. Null urls and those without
    ``://`` have an empty host and path and no tokens but what their query holds. Rows repeat
    as given, null ids too. Other columns are ignored.
    """
    def parsed(df: DataFrame, url: str) -> DataFrame:
        host, path = host_and_path(F.col(url))
        df = df.withColumns({"host": host, "path": path})
        return df.withColumn("items", tokens(F.col(url), F.col("host"), F.col("path")))

    urls = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).withColumn("row", F.monotonically_increasing_id())
    urls = materialise(parsed(urls, "url"), "urls")
    known = parsed(labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad")), "url")
    index = mine(known, support, confidence)
    out = urls.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).join(matched(urls, index), "row", "left")
    verdict = F.coalesce("listed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "listed.rule", verdict.alias("verdict"), "confidence", "mined")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose path names a labelled document: bad if toxic or of low quality."""
    _, path = host_and_path(F.col("url"))
    number = F.regexp_extract(path, "^/[a-z]{2}/([0-9]{1,18})", 1)
    urls = pages.select("url", F.when(number != "", number.cast("long")).alias("doc_id"))
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).cast("int").alias("bad")
    return urls.join(labels.select("doc_id", bad), "doc_id").select("url", "bad")
