"""Token counts without ids: pieces are counted once per distinct pre-token, joined to each document's pre-token frequencies, and summed."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import blocks, bucket_count, rows_digest, utf8
from readloom.llm.exchange import REQUESTS, answer, by_bucket, meet, request_batch, squeeze, tabled, unsqueeze

#: Bytes of text in a block.
BLOCK = 4 << 20
#: Pre-tokens that the library encodes at once.
BATCH = 1024
#: Characters whose classes are the same in all versions of Unicode; other texts are cut by the tokenizer itself.
SETTLED = "\t\n\r" + "".join(map(chr, [*range(0x20, 0x7F), *range(0xA1, 0x250)]))


def _class(kind: str) -> str:
    """The settled characters of a general category, as ranges of a character class."""
    runs: list[list[int]] = []
    for x in (ord(c) for c in SETTLED if unicodedata.category(c)[0] == kind):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)


LETTERS, NUMBERS = _class("L"), _class("N")
#: Fixed value: the split of byte-level BPE into pre-tokens.
PRE_TOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"


class PreTokens:
    """Cuts texts into the pre-tokens of a byte-level tokenizer; a special token is one of its own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cut = re.compile(PRE_TOKENS)
        self.settled = re.compile(f"[{re.escape(SETTLED)}]*")
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _plain(self, text: str) -> list[str]:
        if self.settled.fullmatch(text):
            return self.cut.findall(text)
        return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if not any(x in text for x in self.special):
            return self._plain(text)
        out: list[str] = []
        for part in self.parts.split(text):
            out += [part] if part in self.special else self._plain(part) if part else []
        return out

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        return np.array([len(x.ids) for x in self.whole.encode_batch_fast(tokens, add_special_tokens=False)], np.uint32)


@lru_cache(maxsize=1)
def pre_tokens(path: str) -> PreTokens:
    """The PreTokens of a file, read once in a worker, whatever number of tasks and buckets it works on."""
    return PreTokens(path)


def _pack(strings: list[str]) -> bytes:
    coded = [s.encode() for s in strings]
    return squeeze(np.array([len(coded), *map(len, coded)], "<u4").tobytes() + b"".join(coded))


def _unpack(data: bytes) -> list[str]:
    data = unsqueeze(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, "<u4", n, 4)) + 4 + 4 * n
    return [data[a:b].decode() for a, b in zip([4 + 4 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)] if n else []


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs, by a byte-level BPE file of the tokenizers library.

    n_bytes: of the text's UTF-8. over_limit: more than limit tokens. A null text counts as empty: 0 bytes and tokens. Repeated
    rows and null doc_ids are counted each for itself; other columns are dropped. docs must give the same rows when read again.
    """
    n_buckets = bucket_count(docs)
    slot = lambda tokens: np.fromiter((zlib.crc32(t.encode()) % n_buckets for t in tokens), np.int32, len(tokens))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(tokenizer)
        for block, ids, texts in blocks(batches, BLOCK):
            seen: dict[str, None] = {}
            for text in texts:
                seen.update(dict.fromkeys(cut(text.decode("utf-8", "replace"))))
            tokens = list(seen)
            order, found, starts = by_bucket(slot(tokens))
            yield request_batch(block, rows_digest(ids, list(map(len, texts))), {int(b): _pack([tokens[i] for i in order[s:e]]) for b, s, e in zip(found, starts, starts[1:])})

    def count(payloads: list[bytes]) -> tuple[list[bytes], list[int]]:
        cut, asked = pre_tokens(tokenizer), [_unpack(p) for p in payloads]
        place = {t: i for i, t in enumerate(dict.fromkeys(t for tokens in asked for t in tokens))}
        tokens = list(place)
        pieces = np.concatenate([np.zeros(0, np.uint32), *(cut.pieces(tokens[i : i + BATCH]) for i in range(0, len(tokens), BATCH))])
        return [squeeze(pieces[[place[t] for t in tokens]].astype("<u4").tobytes()) for tokens in asked], []

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokens(tokenizer)
        for block, ids, texts in blocks(batches, BLOCK):
            place: dict[str, int] = {}
            kinds, which, often = array("I"), array("I"), array("I")
            for text in texts:
                bag = Counter(cut(text.decode("utf-8", "replace")))
                kinds.append(len(bag))
                which.extend(place.setdefault(t, len(place)) for t in bag)
                often.extend(bag.values())
            parts = [np.array(x, "<u4").tobytes() for x in (kinds, slot(list(place)), which, often)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([[squeeze(p) for p in parts]], pa.list_(pa.binary()))], ["block", "nth", "ids", "sizes", "parts"])

    def total(answers: list[bytes], block: pa.Table) -> pa.Table:
        kinds, slots, which, often = (np.frombuffer(unsqueeze(p), "<u4").astype(np.int64) for p in block["parts"][0].as_py())
        pieces = np.zeros(len(slots), np.int64)
        pieces[np.argsort(slots, kind="stable")] = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(unsqueeze(a), "<u4") for a in answers)])
        sums = np.append(0, np.cumsum(pieces[which] * often))
        ends = np.cumsum(kinds)
        n = sums[ends] - sums[ends - kinds]
        return tabled(["doc_id", "n_bytes", "n_tokens", "over_limit"], [block["ids"][0].as_py(), block["sizes"][0].as_py(), n, n > limit], [pa.int64(), pa.int64(), pa.int64(), pa.bool_()])

    scan = docs.select(F.col("doc_id").cast("long"), utf8())
    answers = answer(scan.mapInArrow(ask, REQUESTS), count)
    bags = scan.mapInArrow(frequencies, "block long, nth int, ids array<long>, sizes array<long>, parts array<binary>")
    return meet(answers, bags, total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
