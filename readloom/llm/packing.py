"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into full sequences and then into the powers of two of what is left, longest first. Each piece is
a sequence of its own, so no sequence crosses documents and none needs padding; sequences of equal length form a bucket, and a
training batch draws from one bucket.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import rows, utf8

MAX_LENGTH = 4096
SEPARATOR = 2
#: Entries that one worker keeps of the ids of words.
KEPT_WORDS = 300_000

# How printable ASCII and the letters of Latin-1, which every version of Unicode treats alike, are cut when
# lower-cased; and the bytes that stand for themselves in byte-level vocabularies, while others follow from U+0100 on. Chunks
# with other characters are cut by the tokenizer itself.
SETTLED = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
BYTE_LEVEL = dict(zip((b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)), range(256, 512)))


class PartIds(dict):
    """Little-endian 32-bit ids by pre-token. Bounded: it starts afresh when full."""

    def __init__(self, model, kept: int = KEPT_WORDS):
        self.tokenize, self.kept = model.tokenize, kept

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        ids = [t.id for t in self.tokenize(part)]
        self[part] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class WordIds(dict):
    """The same by white-space-free chunk of text, for tokenizers that drop white space."""

    def __init__(self, path: str, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.normal, self.cut, self.kept = self.whole.normalizer, self.whole.pre_tokenizer, kept
        self.parts = PartIds(self.whole.model, kept)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        text = chunk.decode("utf-8", "replace")
        if self.added.search(text):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        else:
            if SETTLED.fullmatch(text):
                parts = PRE_TOKENS.findall(text.lower())
                if not text.isascii():
                    parts = [x.encode().decode("latin-1").translate(BYTE_LEVEL) for x in parts]
            else:
                parts = [x for x, _ in self.cut.pre_tokenize_str(self.normal.normalize_str(text))]
            out = b"".join(map(self.parts.__getitem__, parts))
        self[chunk] = out
        return out

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def decompose(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens: full ones, then the binary digits of the rest from the highest. Longest: a power of two."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pack(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, longest: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece, as PIECES describes; with_ids adds the piece's ids as little-endian 32-bit numbers.

    bucket is the power of two of a piece's length. sequence_id is unique: the partition of the scan and the place in it. The
    separator ends every document, so an empty or null text gives one piece of one token; repeated rows are packed each for
    itself; other columns are dropped. Longest must be a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer), np.array([separator], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        types = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * with_ids
        names = [x.split()[0] for x in schema.split(", ")]
        out: list[tuple] = []
        held = 0
        for doc_id, text in rows(batches):
            ids = words.encode(text) + end
            n, start = len(ids) // 4, 0
            for length in decompose(n, longest):
                piece = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, start, length, zlib.crc32(piece), n, sequence, 0, length.bit_length() - 1) + ((piece,) if with_ids else ()))
                sequence, start = sequence + 1, start + length
            held += len(ids)
            if len(out) >= 8192 or with_ids and held >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(cut_up, schema)
