"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding, gam, mixing, negatives, quality, simhash, suffix, toxicity, urlrules, warc, yinyang
from .common import read


def vocabulary() -> str:
    """The public vocabulary file that the encoding queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read(spark, sf_dir, "documents"), mixing.label_domains(read(spark, sf_dir, "labels")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.page_labels(pages, read(spark, sf_dir, "labels")))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.drop_repeats(read(spark, sf_dir, "documents")))


def op5_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"), segment=16_000)


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    return bpe.digest(bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), path), path))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.windows(chat.with_probe(read(spark, sf_dir, "conversations"))))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_groups(read(spark, sf_dir, "embeddings"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.verdicts(read(spark, sf_dir, "documents")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), label=label)


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clustered(read(spark, sf_dir, "embeddings")).drop("centroid")


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_url_rules": op3_url_rules,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_warc_segments": op5_warc_segments,
    "op6_toxicity_grammar": op6_toxicity_grammar,
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_chat_windows": op8_chat_windows,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_yinyang_clusters": op12_yinyang_clusters,
    "op13_quality_gam": op13_quality_gam,
}
