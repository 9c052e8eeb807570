"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import crf_langid, exact_dedup, hmm_lm, mixing, multi_index, ngram_join, secrets, sentencepiece_codec, sharding, url_filter
from callweave.llm.common import read


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(read(spark, sf_dir, "documents"))


def op2_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.predict_languages(read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(read(spark, sf_dir, "documents"), "doc_id", "text")
    return secrets.digest(found).withColumnRenamed("path", "doc_id").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(read(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.neighbours(read(spark, sf_dir, "embeddings"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "position2")
    return plan.sort(F.col("position").asc_nulls_last(), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
