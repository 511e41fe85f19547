"""From raw documents to packed token sequences: five stages, each a DataFrame in and a DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import importance, packing, quality_rules, shingles, suffix
from millrace.llm.common import written
from millrace.llm.queries import BYTES, table

#: Near copies, exclusions and packing aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return importance.keep_selected(docs, table(spark, sf_dir, "labels"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without lines that are too frequent in their host."""
    return quality_rules.apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return shingles.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long strings that stand earlier in the corpus."""
    return suffix.removed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with their ids."""
    return packing.pack_sequences(docs, BYTES, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules_stage),
    ("near dedup", near_dedup),
    ("suffix dedup", suffix_dedup),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
