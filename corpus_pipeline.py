"""From raw documents to token ids: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import common, crf_langid, exact_dedup, mixing, ngram_join, sentencepiece_codec


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a language: those without a letter, or null, are undetermined and go.

    Rows with a null id and repeated rows are judged like others; an empty table stays empty.
    """
    label = common.fresh(docs, "lang_pred")
    labelled = crf_langid.with_language(docs, label)
    if labelled is None:
        # nothing to learn from: only what has no letter can be rejected
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    return labelled.where(F.col(label) != crf_langid.UNDETERMINED).drop(label)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts (A-Z lower-cased) the row with the largest doc_id, and one of the rows that repeat it.

    A null text counts as empty.  A row with a null id goes if its text stands under an id; of equal texts without any
    id one stays.
    """
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the row with the smallest doc_id.

    Rows that share an id are one document to the join: they stay or go together.  Rows with a null id, and texts
    without a word, are in no class and stay.
    """
    other = common.fresh(docs, "other")
    gone = ngram_join.similarity_classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, in training order.

    Null sources are one source; rows with a null id, and rows that repeat one, are each taken as planned.  A text
    without a word has no size and is not taken.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; a null text is empty.  Columns besides doc_id and text are left out."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: SQL cannot express the learned and probabilistic stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  A stage's table goes when the next one is written; the last one's stays."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    at = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{name}")
        if before is not None:
            common.dropped(before)
        before = docs
    return docs
