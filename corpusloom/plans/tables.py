"""The driver's tables in this domain's shape. Whole tables always."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import spread

#: SQL twins of the views below, to put before a query.
CORPUS_SQL = """corpus AS (SELECT doc_id AS id, text AS raw_text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cleaned_text, source AS source_name,
  CASE lang WHEN 'en' THEN 'news' WHEN 'de' THEN 'literary' WHEN 'fr' THEN 'verse' ELSE 'opinion' END AS register,
  CASE WHEN source IN ('src3', 'src7', 'src11') THEN 'verse' ELSE 'prose' END AS text_type FROM documents)"""
VOTES_SQL = """votes AS (SELECT doc_id AS id, j AS judge,
  CASE WHEN (doc_id * 7919 + j * 104729) % 100 < 10 + 5 * j THEN (t + 1 + (doc_id * 31 + j * 7) % 4) % 5 ELSE t END AS vote,
  0.5 + ((doc_id * 13 + j * 29) % 50) / 100.0::DOUBLE AS confidence
  FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN 0 WHEN doc_id % 10 < 5 THEN 1 WHEN doc_id % 10 < 7 THEN 2 WHEN doc_id % 10 < 9 THEN 3 ELSE 4 END AS t FROM documents) d,
  range(5) AS r(j) WHERE (doc_id * 17 + j * 5) % 97 <> 0)"""


#: Runs of \s but for single spaces, which stay as they are.
_UNEVEN = r" \s+|[\t-\r]\s*"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; those of long texts in as many parts as there are cores at least."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a sentence table: id, raw_text, cleaned_text, source_name, register, text_type."""
    d = table(spark, sf_dir, "documents")
    register = F.when(F.col("lang") == "en", "news").when(F.col("lang") == "de", "literary").when(F.col("lang") == "fr", "verse").otherwise("opinion")
    kind = F.when(F.col("source").isin("src3", "src7", "src11"), "verse").otherwise("prose")
    return d.select(F.col("doc_id").alias("id"), F.col("text").alias("raw_text"), F.trim(F.regexp_replace("text", _UNEVEN, " ")).alias("cleaned_text"), F.col("source").alias("source_name"), register.alias("register"), kind.alias("text_type"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five judges' votes on every document, by whole-number arithmetic: id, judge, vote, confidence."""
    d = F.col("doc_id")
    truth = F.when(d % 10 < 3, 0).when(d % 10 < 5, 1).when(d % 10 < 7, 2).when(d % 10 < 9, 3).otherwise(4).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", truth.alias("t"), F.explode(F.array(*[F.lit(j).cast("long") for j in range(5)])).alias("judge"))
    j = F.col("judge")
    vote = F.when((d * 7919 + j * 104729) % 100 < 10 + 5 * j, (F.col("t") + 1 + (d * 31 + j * 7) % 4) % 5).otherwise(F.col("t"))
    return rows.where((d * 17 + j * 5) % 97 != 0).select(d.alias("id"), j.cast("int").alias("judge"), vote.cast("int").alias("vote"), (0.5 + ((d * 13 + j * 29) % 50) / 100.0).alias("confidence"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("id", "register", "text_type", "source_name")
