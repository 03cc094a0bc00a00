"""Datasets of reads: Parquet folders whose columns carry the tags of the codecs and of the key that they were written with.

A column holds what its codec stores; an omitted field has no column, so it takes no bytes and reads as empty. Spark prunes the
columns that a projection does not ask for, so a key-only scan reads the keys alone.
"""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.errors import CodecMismatch, InvalidOption, KeyMismatch, KeyWidth, LengthMismatch, MissingKey
from readloom.functions import codecs, keys
from readloom.functions.text import DIFFER, checked, from_bytes, text_reads, to_bytes
from readloom.operators.fields import ALL, Fields, fields
from readloom.operators.workflows import BLOCK_RECORDS

FIELDS = ("sequence", "quality", "name")
#: What the run-time error of a bad key starts with.
_KEY = "a record's key"
OMITTED = {"sequence": "omitted", "quality": "omitted", "name": "omitted"}


class _Options:
    def __init__(self) -> None:
        self._codecs = dict.fromkeys(FIELDS, "raw")
        self._key: keys.Key | None = None

    def _codec(self, field: str, name: str):
        codecs.codec(field, name)
        self._codecs[field] = name
        return self

    def sequence_codec(self, name: str):
        return self._codec("sequence", name)

    def quality_codec(self, name: str):
        return self._codec("quality", name)

    def name_codec(self, name: str):
        return self._codec("name", name)

    def two_bit_exact(self):
        return self._codec("sequence", "two_bit_exact")

    def omit_sequence(self):
        return self._codec("sequence", "omitted")

    def omit_quality(self):
        return self._codec("quality", "omitted")

    def omit_names(self):
        return self._codec("name", "omitted")

    def empty_payload(self):
        self._codecs = dict(OMITTED)
        return self

    def record_key(self, name: str):
        """Keys of a registered kind."""
        self._key = keys.key(name)
        return self

    def bytes8_key(self):
        return self.record_key("bytes8")

    def bytes16_key(self):
        return self.record_key("bytes16")


class ReadWriter(_Options):
    """Writes reads: binary or string columns name, sequence and quality, and a key column if, and only if, a key kind is set.

    Rows whose sequence and quality differ in length fail the write with LengthMismatch; only a field that is left out may be
    empty beside a longer one. Leaving out the sequence leaves out the quality as well. Null fields are empty. Keys are given,
    never derived; a null key or one of a wrong width fails the write with KeyWidth. The rows of an empty frame give an empty
    dataset with its columns. Blocks are the row groups of the files.
    """

    def __init__(self) -> None:
        super().__init__()
        self._records = BLOCK_RECORDS
        self._mode = "errorifexists"

    def target_block_records(self, n: int):
        """At most so many records in a block; 0 makes every record a block."""
        if n < 0:
            raise InvalidOption("a block cannot have fewer than 0 records")
        self._records = n
        return self

    def options(self, **options: int):
        """Block targets by name: target_records only, as files are not cut by bytes."""
        if set(options) != {"target_records"}:
            raise InvalidOption(f"unsupported block target: {sorted(options)}")
        return self.target_block_records(options["target_records"])

    def overwrite(self):
        self._mode = "overwrite"
        return self

    def frame(self, reads: DataFrame) -> DataFrame:
        """The columns as they are stored."""
        if ("key" in reads.columns) != (self._key is not None):
            raise MissingKey("a key column needs a key kind, and a key kind a key column")
        rows = reads
        for c in FIELDS:
            if c in reads.columns:
                rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(b"" if dict(reads.dtypes)[c] == "binary" else "")))
        rows = text_reads(rows)
        if {"sequence", "quality"} <= set(rows.columns):
            rows = checked(rows, tuple(c for c in ("sequence", "quality") if self._codecs[c] == "omitted"))
        chosen = dict(self._codecs)
        if chosen["sequence"] == "omitted":
            chosen["quality"] = "omitted"
        out = []
        for c in FIELDS:
            kind = codecs.codec(c, chosen[c])
            if chosen[c] == "omitted":
                continue
            stored = kind.store(F.col(c))
            stored = to_bytes(stored) if rows.select(stored.alias("x")).dtypes[0][1] == "string" else stored
            out.append(stored.alias(c, metadata={"tag": kind.tag}))
        if self._key is not None:
            out.append(self._keys(reads).alias("key", metadata={"tag": self._key.tag, "width": self._key.width}))
        if not out:
            raise InvalidOption("nothing is left to write: set a key or keep a field")
        return rows.select(*out)

    def _keys(self, reads: DataFrame) -> Column:
        if dict(reads.dtypes)["key"] != "binary":
            return F.when(F.col("key").isNull(), F.raise_error(F.lit(f"{_KEY} is null"))).otherwise(F.col("key"))
        fine = F.length("key") == self._key.width
        return F.when(fine, F.col("key")).otherwise(F.raise_error(F.lit(f"{_KEY} has not {self._key.width} bytes")))

    def save(self, reads: DataFrame, path: str) -> None:
        writer = self.frame(reads).write.mode(self._mode).option("parquet.block.row.count.limit", max(1, self._records))
        try:
            writer.parquet(path)
        except PySparkException as fault:
            for text, kind in ((DIFFER, LengthMismatch), (_KEY, KeyWidth)):
                if found := re.search(f"{text}[^\\n]*", str(fault)):
                    raise kind(found[0]) from fault
            raise


class ReadReader(_Options):
    """Reads a dataset with the codecs it was written with; fields come back as binary columns, in any chosen projection.

    Tags are checked when the plan is made, in the order sequence, quality, name, key. A reader without a key kind ignores keys.
    """

    def __init__(self, spark: SparkSession) -> None:
        super().__init__()
        self._spark, self._fields = spark, None

    def select(self, *chosen: str | Fields):
        """The fields to read; a later choice replaces an earlier one."""
        if not chosen:
            raise InvalidOption("no fields are chosen")
        got = [c if isinstance(c, Fields) else fields(c) for c in chosen]
        self._fields = got[0]
        for more in got[1:]:
            self._fields = self._fields | more
        return self

    def load(self, path: str) -> DataFrame:
        stored = self._spark.read.parquet(path)
        tags = {f.name: f.metadata for f in stored.schema.fields}
        for c in FIELDS:
            want = codecs.codec(c, self._codecs[c])
            has = tags[c].get("tag") if c in tags else codecs.codec(c, "omitted").tag
            if has != want.tag:
                raise CodecMismatch(f"{c} was written as {has!r}, not as {want.name}")
        if self._key is not None:
            if "key" not in tags:
                raise MissingKey("the dataset has no keys")
            if (tags["key"].get("tag"), tags["key"].get("width")) != (self._key.tag, self._key.width):
                raise KeyMismatch(f"keys were written as {tags['key'].get('tag')!r}, not as {self._key.name}")
        chosen = self._fields or (ALL if self._key is not None else fields("name", "sequence", "quality"))
        if "key" in chosen.names and self._key is None:
            raise MissingKey("set a key kind to read keys")
        return stored.select(*(self._restored(c, stored) for c in chosen.columns()))

    def _restored(self, c: str, stored: DataFrame) -> Column:
        if c == "key":
            return F.col("key")
        if c not in stored.columns:
            return F.lit(b"").alias(c)
        name = self._codecs[c]
        if name == "raw":
            return F.col(c)
        column = from_bytes(F.col(c)) if dict(stored.dtypes)[c] == "binary" else F.col(c)
        return to_bytes(codecs.codec(c, name).restore(column)).alias(c)


def writer() -> ReadWriter:
    return ReadWriter()


def reader(spark: SparkSession) -> ReadReader:
    return ReadReader(spark)


def local_records(reads: DataFrame):
    """The rows one after another, partition by partition, without collecting them all."""
    return reads.toLocalIterator()


def adapted(rows: DataFrame, name: str, sequence: str, quality: str, phred: bool = False) -> DataFrame:
    """Reads from columns of other names. phred: quality is an array of scores, turned to characters from 33."""
    q = F.array_join(F.transform(F.col(quality), lambda x: F.char(x + 33)), "") if phred else F.col(quality)
    return rows.select(F.col(name).alias("name"), F.col(sequence).alias("sequence"), q.alias("quality"))
