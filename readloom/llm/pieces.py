"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The distinct marked words of a block of documents are sorted, which walks their trie depth first: the forward states of the
prefix that a word shares with the one before are kept, and only the rest of the word is searched.

A forward state is the last piece of the best path to a prefix. For unigram models that is the path of the greatest sum of
scores. Byte-pair models have no sums; there a prefix has one path only, that of its merges, and it goes on by a piece exactly
if that piece and the one before it, taken alone, are merged to these two again. So the same search gives the merges' result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import blocks, utf8

# Fixed values of the model file: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: How much an unknown character scores below the least piece of a unigram model.
UNKNOWN_PENALTY = 10.0
KEPT_WORDS, KEPT_PAIRS = 300_000, 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return n

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """The pieces of a SentencePiece model. Models with a normalizer other than identity are refused."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, dummy_prefix: bool = True):
        self.pieces, self.kind, self.dummy_prefix = pieces, kind, dummy_prefix
        self.ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER_DEFINED)}
        self.scores = [s for _, s, _ in pieces]
        self.unknown = next((i for i, (*_, t) in enumerate(pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.plain = [b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, _, t in pieces]
        self.lowest = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        if kind == BPE and not {c for p in self.ids for c in p} <= self.ids.keys():
            raise ValueError("a character of a piece is not a piece")
        for c in ("\n",):
            if any(c in p for p in self.ids):
                raise ValueError("pieces with line ends are not supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("pieces that cross words are not supported")
        self._build()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, kind, normal, prefix = [], UNIGRAM, b"identity", True
        for n, value in _fields(data):
            if n == 1:
                got = dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
            elif n == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif n == 3:
                got = dict(_fields(value))
                normal, prefix = got.get(1, b"identity"), bool(got.get(3, 1))
                if got.get(4, 1) or not got.get(5, 1):
                    raise ValueError("models that drop white space or do not mark it are not supported")
        if normal != b"identity" or kind not in (UNIGRAM, BPE):
            raise ValueError(f"models of type {kind} with normalizer {normal!r} are not supported")
        return cls(pieces, kind, prefix)

    def _build(self) -> None:
        """An automaton that has, after any text, the pieces that end there, the longest first."""
        self.next: list[dict[str, int]] = [{}]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        self.fail = [0]
        for piece, i in self.ids.items():
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ending.append(())
                    self.fail.append(0)
                node = self.next[node][c]
            self.ending[node] = ((len(piece), i),)
        todo = deque(self.next[0].values())
        while todo:
            node = todo.popleft()
            self.ending[node] += self.ending[self.fail[node]]
            for c, child in self.next[node].items():
                todo.append(child)
                at = self.fail[node]
                while at and c not in self.next[at]:
                    at = self.fail[at]
                self.fail[child] = self.next[at].get(c, 0)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-scored neighbours, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best = max(((scores[ids[a + b]], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def words(self, text: str) -> list[str]:
        """The marked words of a text: no piece crosses their borders."""
        if not text:
            return []
        lead = MARK if self.dummy_prefix else ""
        if "  " in text or text[0] == " " or MARK in text:
            return re.findall(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", lead + text.replace(" ", MARK))
        return list(filter(None, (lead + text.replace(" ", " " + MARK)).replace("\n", " \n ").split(" ")))

    def decode(self, ids: Iterator[int]) -> bytes:
        """The UTF-8 text of ids; the mark of the dummy prefix is dropped."""
        out = b"".join(map(self.plain.__getitem__, ids))
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out


class Encoder:
    """Ids of marked words, little-endian 32-bit numbers, kept for a bounded number of words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _pair(self, a: int, b: int) -> bool:
        """Whether two pieces next to each other stay as they are."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        x, y = self.model.pieces[a][0], self.model.pieces[b][0]
        self.pairs[a, b] = stays = self.model.merge(x + y) == [x, y]
        return stays

    def learn(self, words: set[str]) -> None:
        """Make the ids of all words known, by one walk of the trie of those that are not."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = words
        model, pairs, known = self.model, self.pairs, self.known
        following, fail, ending, scores, merges = model.next, model.fail, model.ending, model.scores, model.kind == BPE
        # by depth: node of the automaton, id of the last piece (-1: an unknown character), its length, and the path's score
        nodes, lasts, sizes, sums = [0], [-1], [0], [0.0]
        before = ""
        for word in sorted(new):
            depth, most = 0, min(len(before), len(word))
            while depth < most and before[depth] == word[depth]:
                depth += 1
            del nodes[depth + 1 :], lasts[depth + 1 :], sizes[depth + 1 :], sums[depth + 1 :]
            for d in range(depth, len(word)):
                c, node = word[d], nodes[d]
                while node and c not in following[node]:
                    node = fail[node]
                node = following[node].get(c, 0)
                last, size, total = -1, 1, sums[d] + model.lowest
                if merges:
                    for n, piece in ending[node]:
                        left = lasts[d + 1 - n]
                        if n > d or left < 0 or (pairs[left, piece] if (left, piece) in pairs else self._pair(left, piece)):
                            last, size = piece, n
                            break
                else:
                    for n, piece in ending[node]:
                        if (s := sums[d + 1 - n] + scores[piece]) > total or n == 1 and last < 0:
                            last, size, total = piece, n, s
                nodes.append(node)
                lasts.append(last)
                sizes.append(size)
                sums.append(total)
            before, d, out = word, len(word), []
            while d:
                if lasts[d] >= 0:
                    out.append(lasts[d])
                elif model.bytes:
                    out += [model.bytes[b] for b in reversed(word[d - 1].encode())]
                else:
                    out.append(model.unknown)
                d -= sizes[d]
            out.reverse()
            known[word] = np.array(out, "<u4").tobytes()


def _encoded(encoder: Encoder, texts: list[bytes]) -> Iterator[bytes]:
    """The ids of each text as little-endian 32-bit numbers; the distinct words of all texts are searched together."""
    words = [encoder.model.words(t.decode("utf-8", "replace")) for t in texts]
    encoder.learn({w for x in words for w in x})
    return (b"".join(map(encoder.known.__getitem__, w)) for w in words)


def _decoded(model: PieceModel, ids: bytes | None) -> bytes:
    return model.decode(np.frombuffer(ids or b"", "<u4").tolist())


ENCODED = "doc_id long, n_bytes long, n_ids long, ids binary"


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """ENCODED of every row of docs: its ids, without begin or end, as little-endian 32-bit numbers, and how many they are.

    A null or empty text has none; repeated rows are encoded each for itself; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel.load(model_path))
        for _, ids, texts in blocks(batches):
            coded = _encoded(encoder, texts)
            for at in range(0, len(ids), 512):
                out = list(islice(coded, 512))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 512], pa.int64()), pa.array(list(map(len, texts[at : at + 512])), pa.int64()), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows with ids as ``encode`` gives them. Null ids give an empty text; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [_decoded(model, x).decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_crc32, round_trip) of every row of docs: crc32 of the ids of ``encode``, and whether decoding them gives the text again.

    A text that holds the mark itself does not come back: the mark is read as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel.load(model_path))
        for _, ids, texts in blocks(batches):
            out = [(doc_id, len(text), len(got) // 4, zlib.crc32(got), _decoded(encoder.model, got) == text) for doc_id, text, got in zip(ids, texts, _encoded(encoder, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 4 + [pa.bool_()], strict=True)], ["doc_id", "n_bytes", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_crc32 long, round_trip boolean")
