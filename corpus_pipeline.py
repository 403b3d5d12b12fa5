"""Corpus pipeline: host rules, quality classifier, near-duplicate removal,
passage removal, packing.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's documents.  All stages but the last return
the columns of ``documents``; the last returns packed pieces with their ids.
SQL cannot express the pipeline (trained classifier, random signatures,
tokenizer), so ``ORACLE_SQL`` is None and the stages are tested against
brute-force versions.

Defined results, for every stage: an empty table gives an empty result; extra
columns are dropped, also if their names clash with those of an operator;
texts are taken whole, however long.  The rules reject null, empty and short
texts; the classifier scores them like any other text; near-duplicate removal
keeps null texts and texts without a word, each for itself, and one row of
equal rows (the least doc_id of a class, null ids last); passage removal drops
no row, keeps null and short texts, and counts repeated rows as copies; packing
gives a null or empty text its end id and packs repeated rows and null ids like
any other.  Ties in a score go to the threshold (kept at or above it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import host_rules, near_dedup, packing, quality_knn, suffix_dedup
from tillroll.llm.common import query, table, written
from tillroll.llm.queries import learn_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep."""
    return host_rules.keep_documents(docs).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    scored = quality_knn.score_quality(docs, learn_quality(spark, docs, sf_dir))
    return scored.where(F.col("score") >= quality_knn.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere."""
    return suffix_dedup.strip_passages(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packed_sequences),
]

ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
