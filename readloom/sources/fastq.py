"""FASTQ text and length-prefixed binary records.

FASTQ is read line by line, so files are split. A first scan counts the lines of each split and keeps its first three; their
sums over the splits before tell where reads start in a split, and the lines with which the splits after it begin complete its
last read. So the second scan makes reads of four lines each without a shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.sources.temp import TempDataset


def to_fastq(reads: DataFrame) -> DataFrame:
    """(value): each read of string columns as four lines."""
    return reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value"))


def write_fastq(reads: DataFrame, path: str) -> None:
    to_fastq(reads).write.mode("overwrite").text(path)


#: Splits whose counts may be broadcast; those of more are joined by a shuffle.
MANY_SPLITS = 50_000
SPLITS = "file string, start long, first long, n long, head array<string>"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SPLITS of the rows (file, start, id, value) of a task."""
    found: dict[tuple, list] = {}
    for batch in batches:
        file, start, ids, value = batch.columns
        keys = list(zip(file.to_pylist(), start.to_pylist()))
        at = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])] if keys else []
        for i, j in zip(at, [*at[1:], len(keys)]):
            one = found.setdefault(keys[i], [ids[i].as_py(), 0, []])
            one[1] += j - i
            one[2] += value.slice(i, min(j - i, 3 - len(one[2]))).to_pylist()
    rows = [(*k, *v) for k, v in found.items()]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["file", "start", "first", "n", "head"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads from rows (line, value, more): the number of a line in its file, and, at the last line of a split, those that come after it."""
    open_: list = []  # the lines of a read that goes on
    begin = True
    for batch in batches:
        line, value, more = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2)
        ends = pc.indices_nonzero(more.is_valid()).to_pylist()
        whole: list = []
        for i, j in zip([0, *(e + 1 for e in ends)], [*(e + 1 for e in ends), len(value)]):
            if i == j:
                continue
            skip = int(-line[i] % 4) if begin else 0  # lines of a read that starts in the split before
            open_ += value[min(j, i + skip) : j]
            begin = False
            n = len(open_) // 4 * 4
            whole += open_[:n]
            open_ = open_[n:]
            if j - 1 in ends:
                if open_:
                    open_ += more[j - 1].as_py()[: 4 - len(open_)]
                    whole += open_ + [None] * (4 - len(open_))
                open_, begin = [], True
        yield pa.RecordBatch.from_arrays([pa.array(whole[i::4], pa.string()) for i in range(4)], ["head", "sequence", "plus", "quality"])


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, sequence, quality) as strings. Empty lines at the end of a file are left out; malformed reads fail at run time."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    scratch = TempDataset(spark)
    _COUNTS.append(scratch)
    scratch.write(lines.mapInArrow(_count, SPLITS))
    splits, order = scratch.read(), Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    none = F.array().cast("array<string>")
    more = F.concat(*(F.coalesce(F.lead("head", i).over(order), none) for i in (1, 2, 3)))
    splits = splits.select("file", "start", "first", "n", before.alias("before"), more.alias("more"))
    nth = F.col("id") - F.col("first")
    if scratch.read().limit(MANY_SPLITS + 1).count() <= MANY_SPLITS:
        numbered = lines.join(F.broadcast(splits), ["file", "start"])
    else:
        numbered = lines.join(splits, ["file", "start"]).sortWithinPartitions("id")
    reads = numbered.select((F.col("before") + nth).alias("line"), "value", F.when(nth == F.col("n") - 1, F.col("more")).alias("more")).mapInArrow(_assemble, "head string, sequence string, plus string, quality string")
    blank = (F.col("head") == "") & (F.coalesce("sequence", F.lit("")) == "") & (F.coalesce("quality", F.lit("")) == "")
    fine = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("sequence") == F.length("quality"))
    name = F.when(F.coalesce(fine, F.lit(False)), F.substr("head", F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("malformed read: "), "head")))
    return reads.where(~blank).select(name.alias("name"), "sequence", "quality")


#: Counts of files that are still to be read; they go when the interpreter or the JVM ends.
_COUNTS: list[TempDataset] = []


def to_records(reads: DataFrame) -> DataFrame:
    """(record): each read of binary columns as name length, name, sequence length, sequence, quality; lengths are little-endian 32-bit numbers."""
    size = lambda c: F.unhex(F.concat(*(F.substr(F.lpad(F.hex(F.length(c)), 8, "0"), F.lit(i), F.lit(2)) for i in (7, 5, 3, 1))))
    return reads.select(F.concat(size("name"), "name", size("sequence"), "sequence", "quality").alias("record"))


READ = "name binary, sequence binary, quality binary"
#: Bytes of reads that are handed on at once.
BATCH = 4 << 20


def _table(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["name", "sequence", "quality"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The reads of all records, many at once however few a value holds."""
    out, size = [], 0
    for batch in batches:
        for value in batch.column(0):
            data, at = value.as_py() or b"", 0
            while at < len(data):
                (n,) = struct.unpack_from("<I", data, at)
                name = data[at + 4 : at + 4 + n]
                start = at + 4 + n
                (n,) = struct.unpack_from("<I", data, start)
                end = start + 4 + 2 * n
                if end > len(data):
                    raise ValueError("a record is cut off")
                out.append((name, data[start + 4 : start + 4 + n], data[start + 4 + n : end]))
                size, at = size + end - at, end
                if len(out) == 8192 or size >= BATCH:
                    yield _table(out)
                    out, size = [], 0
    if out:
        yield _table(out)


def from_records(frame: DataFrame, column: str = "content") -> DataFrame:
    """The reads of a binary column that holds any number of records, such as files of the binaryFile source. A cut-off record fails the task."""
    return frame.select(column).mapInArrow(_parse, READ)
