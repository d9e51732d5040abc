"""A training-data pipeline: five stages, each over all rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import line_dedup, packing, quality_classifier, quality_rules, simhash
from motifmill.llm.common import stored, table

#: Trained trees and searched fingerprints have no SQL; tests hold each stage's operator against brute force, and run() against the stages.
ORACLE_SQL = None


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier accepts. It learns from the corpus's labelled documents, not only `docs`."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.score_column(model, F.col("text"), spark) >= quality_classifier.THRESHOLD)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the base rules and the trees, which learn from the corpus's labelled documents."""
    trees = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.where(quality_rules.kept_column(trees, F.col("text"), spark))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs from the texts; every document stays, n_chars follows its text."""
    out = line_dedup.line_dedup(docs, counts=("__lines", "__deleted"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the least doc_id, then text hash, of repeated rows one. A document
    without an id stays only if no other of its group has one."""
    return simhash.one_of_each_group(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts' tokens into sequences; one row a piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", dedup_near_copies),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; each result is written and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
