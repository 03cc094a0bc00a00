"""The queries of this subpackage over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import language_model, licenses, pieces, quality, simhash, suffix_dedup, toxicity
from readloom.llm.common import documents
from readloom.llm.matroska import document_cues, document_packets, media_round_trip
from readloom.llm.packing import pack
from readloom.llm.token_counts import count_tokens


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(documents(spark, sf_dir))


def host_quality_of_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules with languages as hosts: one of them fails in the test data, as the hosts there do not."""
    return quality.host_quality(documents(spark, sf_dir), "lang")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(documents(spark, sf_dir))


def matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet table of the stored media of all documents."""
    return document_packets(documents(spark, sf_dir))


def matroska_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cue table of the stored media of all documents."""
    return document_cues(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_model, op2_host_quality, op3_simhash, op4_matroska, op5_packing, op6_pieces, op7_token_counts, op8_licenses, op9_suffix_dedup, op10_toxicity, host_quality_of_languages, matroska_packets, matroska_cues)}


def oracle_sql() -> dict[str, str]:
    return {"op2_host_quality": quality.ORACLE, "host_quality_of_languages": quality.LANGUAGE_ORACLE, "op8_licenses": licenses.ORACLE}
