"""An exchange between blocks of documents and statistics of the whole corpus.

Blocks ask buckets about distinct keys (tokens, n-grams, anchors), packed by bucket; a bucket sees each key from all blocks at
once, works on it once, and answers each block in the order in which it asked. Both sides are plain Spark shuffles: a bucket is
a slice of the hash space that shrinks as shuffle partitions are added, and a block has a bounded size, so a key that occurs in
every document is one entry for each block, never a hot group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import rows_digest

REQUESTS = "bucket int, block long, digest long, payload binary"
ANSWERS = "block long, digest long, bucket int, payload binary, sums array<long>"
_R = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("payload", pa.binary())])
_A = pa.schema([("block", pa.int64()), ("digest", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("sums", pa.list_(pa.int64()))])
#: The block of the row that carries the sums of a bucket.
SUMS = -1


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.decompress(data)


def request_batch(block: int, mark: int, payloads: dict[int, bytes]) -> pa.RecordBatch:
    """The requests of one block, whose ``digest`` is mark: a payload for each bucket."""
    n = len(payloads)
    return pa.RecordBatch.from_arrays([pa.array(list(payloads), pa.int32()), pa.array([block] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array(list(payloads.values()), pa.binary())], schema=_R)


def answer(requests: DataFrame, work: Callable[[list[bytes]], tuple[list[bytes], list[int]]]) -> DataFrame:
    """Answers of all buckets. work: gets what the blocks sent to one bucket, in the order of their ids, and gives an answer to each, and sums of the bucket."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        got, sums = work(table["payload"].to_pylist())
        n = table["bucket"][0].as_py()
        return pa.Table.from_arrays([pa.array([*table["block"].to_pylist(), SUMS], pa.int64()), pa.array([*table["digest"].to_pylist(), None], pa.int64()), pa.array([n] * (len(got) + 1), pa.int32()), pa.array([*got, None], pa.binary()), pa.array([None] * len(got) + [sums], pa.list_(pa.int64()))], schema=_A)

    return requests.groupBy("bucket").applyInArrow(bucket, ANSWERS)


def totals(answers: DataFrame, n: int) -> list[int]:
    """The n sums of all buckets added up."""
    found = answers.where(F.col("block") == SUMS).agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(n))).first()
    return [x or 0 for x in found]


def meet(answers: DataFrame, blocks: DataFrame, work: Callable[[list[bytes], pa.Table], pa.Table], schema: str) -> DataFrame:
    """Join answers with the rows of their blocks. work: gets the answers of one block by rising bucket, and the block's rows.

    A task fails if a block does not hold the rows that it held when it asked: the input must give the same rows when read
    again. Rows of blocks have ids and sizes, in the order of nth.
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.sort_by("nth").select(["ids", "sizes"]).to_pylist() if right.num_rows else []
        mark = rows_digest([i for r in rows for i in r["ids"]], [n for r in rows for n in r["sizes"]])
        if any(x != mark for x in left["digest"].to_pylist()):
            raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
        return work(left.sort_by("bucket")["payload"].to_pylist(), right)

    return answers.where(F.col("block") != SUMS).drop("sums").groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(block, schema)


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, buckets, starts): positions sorted by bucket, stable; the buckets that occur; where each starts in that order."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, found, np.append(starts, len(order))


def tabled(names: list[str], columns: list, types: list[pa.DataType]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def to_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit hash: equal ranges of the hash space."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)



def pack_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit numbers as compressed byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeeze(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64)[:, 0], dtype=np.uint64)


def framed(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out
