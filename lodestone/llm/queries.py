"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, line_dedup, media, mixing, quality, sharding, simhash, syncmers, token_files, toxicity
from lodestone.llm.common import documents, labels, pattern, tokenizer


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), pattern())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op6_quality": op6_quality,
    "op5_simhash": op5_simhash,
    "op8_token_files": op8_token_files,
    "op9_media": op9_media,
    "op4_fingerprints": op4_fingerprints,
    "op7_mixing": op7_mixing,
    "op10_sharding": op10_sharding,
}


def sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.oracle_sql(), "op7_mixing": mixing.oracle_sql(), "op10_sharding": sharding.oracle_sql()}
