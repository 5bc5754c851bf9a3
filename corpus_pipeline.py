"""The corpus pipeline: language ID, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`, with n_chars counted anew where a text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language, near, packing, passages, pii
from corpusloom.llm.common import documents, scratch, stored


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is predicted with enough confidence; rejected ones (und) go, as do texts without letters."""
    model = language.train(docs)
    return language.predict(docs, model, reject=True, keep=docs.columns).where(F.col("lang_pred") != language.UND).select(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near-duplicates (five words, similarity 0.8 or more)."""
    gone = near.near_groups(docs, shingle=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document has."""
    return _counted(passages.without_repeats(docs))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    return packing.pack(docs)


STAGES = [("language", identified), ("near_duplicates", deduplicated), ("passages", without_passages), ("personal_data", redacted), ("packing", packed)]

#: No stage can be stated in SQL: a trained model, sketches, trees and a search take part. Tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    *first, (_, last) = STAGES
    with scratch(spark):  # what a stage left for the next one goes once the last has read it
        for name, stage in first:
            with scratch(spark):
                docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        return last(spark, docs, sf_dir)
