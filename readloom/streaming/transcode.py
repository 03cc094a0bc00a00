"""Reads as they arrive: a stream of files is transcoded and keyed without state, and written once for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from readloom.operators.workflows import transcode


def stream_reads(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The reads of the Parquet files in a folder and of those that come later; the schema is that of the files there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_transcoded(reads: DataFrame, profile: dict[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """Transcode a stream of string-typed reads into a folder, each input file once; it ends when no files are left."""
    return transcode(reads, profile).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
