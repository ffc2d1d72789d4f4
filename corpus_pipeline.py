"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on all that the one before it kept; between stages the documents are a
Parquet table in the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import bpe, mixing, neardup, quality, suffix
from siftline.llm.common import materialise, read, release, relieve, scratch
from siftline.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that too many texts of their source share."""
    return quality.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings of 200 bytes that are anywhere else as well."""
    relieve(spark)
    return suffix.cleaned(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, so that domains meet their targets."""
    relieve(spark)
    return mixing.mixed(docs, mixing.label_domains(read(spark, sf_dir, "labels")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the token ids of every text, 4 bytes each.

    One row per row of ``docs``, null ids and repeated rows too. Null and empty texts have no tokens; an empty
    table gives an empty one; other columns are left out.
    """
    relieve(spark)
    ids = bpe.encode(docs, vocabulary())
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_strings", repeated_strings),
    ("mix_domains", mix_domains),
    ("encode", encode),
]

#: Near copies, repeated strings, rates and token ids are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and what it read, is deleted once its own table is there."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            after = materialise(stage(spark, docs, sf_dir), name)
            kept.append(after)
        release(docs)  # a table of a stage; the documents themselves stay
        docs = after
    return docs
