"""Reads as columns: bytes and text, checks, and the text form of a read.

Fields of a read are bytes. Expressions work on strings; ISO 8859-1 maps all 256 bytes to characters and back, so binary columns
go through it without loss. An omitted field is empty, a field that was not selected is no column, and the only null is a key
that cannot be derived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

READ = T.StructType([T.StructField(c, T.BinaryType(), False) for c in ("name", "sequence", "quality")])
KEYED_READ = T.StructType([*READ.fields, T.StructField("key", T.BinaryType(), True)])


def from_bytes(column: Column) -> Column:
    return F.decode(column, "ISO-8859-1")


def to_bytes(column: Column) -> Column:
    return F.encode(column, "ISO-8859-1")


def on_bytes(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of string columns as one of binary columns."""
    return lambda column: to_bytes(function(from_bytes(column)))


def text_reads(reads: DataFrame) -> DataFrame:
    """reads with string fields instead of binary ones; a key stays."""
    kinds = dict(reads.dtypes)
    return reads.withColumns({c: from_bytes(F.col(c)) for c in ("name", "sequence", "quality") if kinds.get(c) == "binary"})


def mismatched(sequence: str = "sequence", quality: str = "quality") -> Column:
    """Whether a read's sequence and quality differ in length."""
    return F.length(sequence) != F.length(quality)


#: What the run-time error of ``checked`` starts with.
DIFFER = "sequence and quality differ in length"


def checked(reads: DataFrame, may_be_empty: tuple[str, ...] = ()) -> DataFrame:
    """reads, failing at run time at one whose sequence and quality differ in length. The fields of may_be_empty may be so beside a longer one."""
    wrong = mismatched()
    for field in may_be_empty:
        wrong &= F.length(field) > 0
    message = F.concat(F.lit(f"{DIFFER}: "), F.length("sequence").cast("string"), F.lit(" and "), F.length("quality").cast("string"))
    return reads.withColumns({c: F.when(wrong, F.raise_error(message)).otherwise(F.col(c)) for c in ("sequence", "quality")})


def canonical(sequence: str = "sequence") -> Column:
    """Whether all bases are A, C, G or T, in either case."""
    return F.col(sequence).rlike(r"^[ACGTacgt]*\z")


def shown(name: str = "name", sequence: str = "sequence") -> Column:
    """A read as one line: name, sequence and length."""
    return F.format_string("%s\t%s\t(%d bp)", F.col(name), F.col(sequence), F.length(sequence))
