"""What keyed reads are for: sorting, runs, partitions, blocks, presets and size reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import codecs, keys

COMPACT = {"sequence": "two_bit_exact", "quality": "binned", "name": "split"}
RAW = {"sequence": "raw", "quality": "raw", "name": "raw"}
BLOCK_RECORDS = 8192


def external_sort(reads: DataFrame, *by: str) -> DataFrame:
    """All rows in order, the last of by a tie-break: ranges of keys are exchanged and each is sorted with spill."""
    return reads.orderBy(*by)


def sorted_runs(reads: DataFrame, chunk: int, order: str, *by: str) -> DataFrame:
    """reads with run and place: chunks of consecutive rows by a dense number from 0, and the rank by the given columns inside."""
    run = F.floor(F.col(order) / chunk).cast("bigint")
    return reads.withColumn("run", run).withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(*by)))


def sort_violations(ordered: DataFrame, chunk: str, order: str, key: str) -> DataFrame:
    """(violations): neighbours inside a chunk whose keys fall. Chunks are checked apart, so no task gets all rows."""
    before = F.lag(key).over(Window.partitionBy(chunk).orderBy(order))
    return ordered.select((before > F.col(key)).alias("falls")).agg(F.count(F.when(F.col("falls"), 1)).alias("violations"))


def sort_report(ordered: DataFrame, key: str) -> DataFrame:
    """(n_rows, ties, falls, first, last) of the rows in the order in which ordered gives them, over the bounds of partitions as well.

    ties and falls count neighbours whose keys are equal and fall. Each partition is checked apart and gives one row.
    """
    placed = ordered.select(F.col(key).alias("k"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    before = F.lag("k").over(Window.partitionBy("part").orderBy("id"))
    count = lambda c: F.count(F.when(c, 1))
    inside = placed.withColumn("before", before).groupBy("part").agg(F.count("*").alias("n"), count(F.col("before") == F.col("k")).alias("ties"), count(F.col("before") > F.col("k")).alias("falls"), F.min_by("k", "id").alias("first"), F.max_by("k", "id").alias("last"))
    met = inside.withColumn("before", F.lag("last").over(Window.orderBy("part")))  # a row for each partition
    total = lambda c, more: (F.coalesce(F.sum(c), F.lit(0)) + count(more)).alias(c)
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), total("ties", F.col("before") == F.col("first")), total("falls", F.col("before") > F.col("first")), F.min_by("first", "part").alias("first"), F.max_by("last", "part").alias("last"))


def first_base_bucket(sequence: str = "sequence") -> Column:
    """1 for C, 2 for G, 3 for T, else 0."""
    first = F.substr(F.col(sequence), F.lit(1), F.lit(1))
    return F.when(first == "C", 1).when(first == "G", 2).when(first == "T", 3).otherwise(0)


def kmer_bucket(key: str = "key", n: int = 4) -> Column:
    return F.pmod(F.col(key), F.lit(n)).cast("int")


def write_partitioned(reads: DataFrame, path: str, bucket: Column) -> None:
    """reads in one folder for each value of bucket. Rows of one bucket may come from many tasks, so a large one is not one task's."""
    reads.withColumn("bucket", bucket).write.partitionBy("bucket").mode("overwrite").parquet(path)


def bucket_counts(reads: DataFrame, bucket: Column) -> DataFrame:
    return reads.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_reads"))


def block_layout(numbered: DataFrame, order: str, records: int = BLOCK_RECORDS) -> DataFrame:
    """(block, n_records, first, last) of blocks of consecutive rows by a dense number from 0. records of 0 gives a block for each row."""
    block = F.floor(F.col(order) / max(records, 1)).cast("bigint")
    return numbered.groupBy(block.alias("block")).agg(F.count("*").alias("n_records"), F.min(order).alias("first"), F.max(order).alias("last"))


def once(reads: DataFrame, column: Column, name: str) -> DataFrame:
    """reads with a column that is computed once for each row, however often it is used: a filter on it is not moved below."""
    return reads.select("*", F.explode(F.array(column)).alias(name))


def with_key(reads: DataFrame, kind: str, **options: int) -> DataFrame:
    """reads with a derived key; those without one are dropped."""
    derive = {"prefix_kmer": keys.prefix_kmer, "minimizer": keys.minimizer}.get(kind) or keys.key(kind).derive
    return once(reads, derive(F.col("sequence"), **options), "key").where(F.col("key").isNotNull())


def preset(reads: DataFrame, kind: str, *payload: str, **options: int) -> DataFrame:
    """Derived keys with some of the fields, all others left out."""
    return with_key(reads, kind, **options).select(*payload, "key")


def transcode(reads: DataFrame, profile: dict[str, str]) -> DataFrame:
    """reads as they are after storing with the codecs of a profile."""
    return reads.withColumns({c: codecs.codec(c, n).round_trip(F.col(c)) for c, n in profile.items()})


def stored_size(profile: dict[str, str]) -> Column:
    """Bytes of a read's fields in the packed form of a profile."""
    sizes = [codecs.codec(c, n).size(F.col(c)) for c, n in profile.items()]
    return sum(sizes[1:], sizes[0])


def size_report(reads: DataFrame, profile: dict[str, str], against: dict[str, str]) -> DataFrame:
    """(n_reads, bytes, bytes_against) of reads under two profiles."""
    return reads.agg(F.count("*").alias("n_reads"), F.sum(stored_size(profile)).alias("bytes"), F.sum(stored_size(against)).alias("bytes_against"))
