"""What several operators share: reading the tables, durable cuts of the lineage, and blocks of bounded size."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block may hold, unless a single document is longer.
BLOCK_BYTES = 8 << 20
#: Bytes of text for which an exchange has a bucket: it bounds what one group of a bucket holds.
BUCKET_BYTES = 32 << 20
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. It is set here only where the session names none and runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "readloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Spark's switch for removing the shuffle files of a query when it ends, rather than when its plan is garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no recomputation.

    The shuffle files behind it are not needed any more and go at once.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(_CLEAN, before)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder on any file system of Spark's."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_cuts(spark: SparkSession, folder: str) -> Iterator[None]:
    """Cuts made inside are kept in folder and go with it at the end; results that still need them must be written by then."""
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield
    finally:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        remove(spark, folder)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, cut, and marked for a broadcast if it has at most so many rows; a larger one is left to a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def utf8(text: str = "text") -> Column:
    """The UTF-8 bytes of a text; none for a null."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """Buckets of an exchange over docs, so that one stands for at most BUCKET_BYTES of text, and a few for each shuffle partition."""
    size = steady(docs).agg(F.sum(F.octet_length(F.col(text).cast("binary")))).first()[0] or 0
    return max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def rows(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches, turned to Python objects a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def steady(docs: DataFrame) -> DataFrame:
    """docs, in a session that splits files alike each time they are scanned, also after executors were lost.

    Rows that are known by their place in a scan need this. A setting that the session has already stays.
    """
    spark = docs.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return docs


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list]]:
    """(block id, doc_ids, texts) of (doc_id, bytes) rows.

    A block ends where its bytes reach the limit. Its id is what monotonically_increasing_id gives its first row, so two passes
    over the same scan, and a task that is run again, number blocks alike, and the row at place i of a block has the id plus i.
    """
    part = TaskContext.get()
    row, size = (part.partitionId() if part else 0) << 33, 0
    ids: list = []
    texts: list = []
    for doc_id, text in rows(batches):
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= limit or len(ids) >= 1 << 16:
            yield row, ids, texts
            row, size, ids, texts = row + len(ids), 0, [], []
    if ids:
        yield row, ids, texts


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(some rows, their texts as bytes) of Arrow batches with all their columns; the texts, in a column of strings, stay within limit bytes, unless a single one is longer."""
    for batch in batches:
        texts = batch.column(column).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(sizes.searchsorted(before + limit, "right")))
            yield batch.slice(start, end - start), [t or b"" for t in texts.slice(start, end - start).to_pylist()]
            start = end


def rows_digest(ids: list, sizes: list[int]) -> int:
    """A number by which two passes over the same input can tell that a block holds the same rows."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(repr((ids, sizes)).encode()) >> 1


BLOCK_ROWS = "block long, nth int, ids array<long>, sizes array<long>, text binary"


def block_rows(scan: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows (doc_id, bytes) by block, as ``blocks`` gives it, some in a row: nth is the place of the first, text all their bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, limit):
            for at in range(0, len(ids), 512):
                part = texts[at : at + 512]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int32()), pa.array([ids[at : at + 512]], pa.list_(pa.int64())), pa.array([list(map(len, part))], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(part), 1)], pa.binary())], ["block", "nth", "ids", "sizes", "text"])

    return scan.mapInArrow(run, BLOCK_ROWS)


def block_texts(table: pa.Table) -> tuple[list, list[bytes]]:
    """(doc_ids, texts) of the rows of one block of ``block_rows``."""
    ids: list = []
    texts: list[bytes] = []
    for row in table.sort_by("nth").to_pylist():
        data, at = zstandard.decompress(row["text"]), 0
        ids += row["ids"]
        for n in row["sizes"]:
            texts.append(data[at : at + n])
            at += n
    return ids, texts
