"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, chat, importance, langid, packing, quality_rules, records, simhash, suffix, telephony

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary files, by the name that the tokenizers' package gives them.
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(table(spark, sf_dir, "conversations"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"))


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.records(table(spark, sf_dir, "documents"), WORDS, end_id=2)


def op5_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.digests(telephony.store(table(spark, sf_dir, "documents")))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORDS)


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTES, end_id=1)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_preferences, op2_simhash, op3_quality_rules, op4_records, op5_telephony, op6_suffix, op7_bpe, op8_importance, op9_packing, op10_langid)}
ORACLE_SQL: dict[str, str] = {"op1_preferences": chat.SQL, "op3_quality_rules": quality_rules.SQL}
