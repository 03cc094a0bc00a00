"""From raw documents to packed sequences: five stages, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import packing, quality, simhash, suffix_dedup, toxicity
from readloom.llm.common import documents, passing_cuts, remove, shared_dir
from readloom.llm.queries import vocabulary


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules, from hosts that do."""
    return quality.keep_good(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies by shingles of five words."""
    return simhash.keep_one(docs, similar=True)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that occur earlier."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", civil), ("quality rules", good), ("SimHash near-dedup", unlike), ("suffix-array dedup", unrepeated), ("packing", packed)]

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. What a stage keeps is written to the shared folder as Parquet and read again.

    What a stage cut its lineage with goes when it is written, and what it read when the next one is; the last one's rows stay.
    """
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        with passing_cuts(spark, f"{folder}/cuts-{n}"):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
