"""The corpus pipeline: quality, exact dedup, near dedup, secrets, packing, over the documents table.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of documents, and each works on what the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import exact_dedup, minhash, packing, quality, secrets
from leafmark.llm.common import crc_mod5, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more; it learns from the labels table's training folds."""
    model = quality.train(docs.where(crc_mod5(F.col("doc_id")) != 0), quality.trusted(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the largest doc_id."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return minhash.keep_one(docs, minhash.near_dedup(docs))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document, or piece of a long one, goes: bin, size of the bin, place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor greedy packing; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = stored(spark, docs, f"stage{k}")
    return docs
