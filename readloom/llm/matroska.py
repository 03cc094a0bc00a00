"""Media columns in Matroska: a writer for PCM payloads and a reader that turns files into packet tables.

The reader parses variable-length EBML elements (unknown sizes included), clusters, simple blocks and block groups, the three
kinds of lacing, and cues. ``packets`` gives one row per packet with its timestamp, track and byte range in the file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from readloom.llm.common import blocks, rows, utf8

# Fixed values of the container format: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

SAMPLE_RATE, FRAME, LACED, CLUSTER_BLOCKS = 8000, 512, 8, 16

PACKETS = "cluster int, track int, timestamp_ns long, keyframe boolean, lacing int, position long, size long"
CUE_ROWS = "time_ns long, track int, cluster_position long"


def _size(n: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones value of a width is reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(key: int, n: int) -> bytes:
    return _element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], kind: int) -> bytes:
    if kind == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            head += _size(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def write_pcm(payload: bytes) -> bytes:
    """A Matroska file that holds payload as one track of unsigned 8-bit samples. Equal payloads give equal files."""
    head = _element(EBML, _element(DOC_TYPE, b"matroska"))
    audio = _element(SAMPLING_FREQUENCY, bytes.fromhex("45fa0000")) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8)
    track = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(DEFAULT_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, audio)
    body = [_element(INFO, _number(TIMESTAMP_SCALE, 1_000_000)), _element(TRACKS, _element(TRACK_ENTRY, track))]
    at, cues, span = sum(map(len, body)), [], FRAME * LACED
    for start in range(0, len(payload), span * CLUSTER_BLOCKS):
        time = start * 1000 // SAMPLE_RATE
        inside = [_number(TIMESTAMP, time)]
        for n, block in enumerate(range(start, min(len(payload), start + span * CLUSTER_BLOCKS), span)):
            frames = [payload[i : min(i + FRAME, block + span)] for i in range(block, min(len(payload), block + span), FRAME)]
            even = len({len(f) for f in frames}) == 1
            kind = NO_LACING if len(frames) == 1 else FIXED if even and n % 3 == 0 else XIPH if n % 3 == 1 else EBML_LACING
            later = block * 1000 // SAMPLE_RATE - time
            inside.append(_element(SIMPLE_BLOCK, b"\x81" + later.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + _laced(frames, kind)))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        body.append(_element(CLUSTER, b"".join(inside)))
        at += len(body[-1])
    return head + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, marker: bool) -> tuple[int | None, int]:
    """(value, next position); the value of a size with all ones is None: unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"EBML number cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of the elements between two positions."""
    while at < end:
        key, at = _vint(data, at, True)
        n, at = _vint(data, at, False)
        if n is None:  # runs to the next element that cannot be its child
            stop = at
            inside = TOP_LEVEL if key == CLUSTER else set()
            while stop < end:
                child, body = _vint(data, stop, True)
                if child in inside:
                    break
                size, body = _vint(data, body, False)
                if size is None:
                    stop = end
                    break
                stop = body + size
        else:
            stop = at + n
        if stop > end:
            raise ValueError(f"element {key:#x} ends beyond its parent at byte {end}")
        yield key, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(position, size) of the frames of a block whose lacing header starts at a position."""
    if kind == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise ValueError(f"lacing cut off at byte {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError(f"fixed lacing of uneven size at byte {at}")
        sizes = [(end - at) // count] * (count - 1)
    for n in range(count - 1 if kind != FIXED else 0):
        if kind == XIPH:
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise ValueError(f"lacing cut off at byte {at}")
            size, at = size + data[at], at + 1
        else:
            width = 9 - data[at].bit_length() if data[at] else 9
            raw, at = _vint(data, at, False)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size = raw if n == 0 else sizes[-1] + raw - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lacing sizes exceed the block that ends at byte {end}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def walk(data: bytes) -> Iterator[tuple[str, tuple]]:
    """("packets", row), ("cues", row) and ("error", (fault,)) of a file as they are read, as PACKETS and CUE_ROWS describe.

    The frames of a laced block follow each other by the default duration of their track; without one all have the block's
    time. A malformed file gives what was read before the fault, and the fault; an empty one gives neither packets nor an error.
    """
    durations: dict[int, int] = {}
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    try:
        for key, at, end in _children(data, 0, len(data)):
            if key != SEGMENT:
                continue
            scale, cluster, origin = 1_000_000, -1, at
            for key, a, b in _children(data, at, end):
                if key == INFO:
                    scale = next((number(x, y) for k, x, y in _children(data, a, b) if k == TIMESTAMP_SCALE), scale)
                elif key == TRACKS:
                    for k, x, y in _children(data, a, b):
                        if k == TRACK_ENTRY:
                            parts = {k: number(p, q) for k, p, q in _children(data, x, y) if k in (TRACK_NUMBER, DEFAULT_DURATION)}
                            durations[parts.get(TRACK_NUMBER, 0)] = parts.get(DEFAULT_DURATION, 0)
                elif key == CLUSTER:
                    cluster, base = cluster + 1, 0
                    for kind, x, y in _children(data, a, b):
                        if kind == TIMESTAMP:
                            base = number(x, y)
                            continue
                        simple, keyed = kind == SIMPLE_BLOCK, True
                        if kind == BLOCK_GROUP:
                            parts = {k: (p, q) for k, p, q in _children(data, x, y)}
                            if BLOCK not in parts:
                                continue
                            keyed, (x, y) = REFERENCE_BLOCK not in parts, parts[BLOCK]
                        elif not simple:
                            continue
                        track, p = _vint(data, x, False)
                        if p + 3 > y:
                            raise ValueError(f"block cut off at byte {p}")
                        time, flags = int.from_bytes(data[p : p + 2], "big", signed=True), data[p + 2]
                        lacing = flags >> 1 & 3
                        for nth, (position, size) in enumerate(_frames(data, p + 3, y, lacing)):
                            yield "packets", (cluster, track, (base + time) * scale + nth * durations.get(track, 0), bool(flags & 0x80) if simple else keyed, lacing, position, size)
                elif key == CUES:
                    for k, x, y in _children(data, a, b):
                        if k == CUE_POINT:
                            time = 0
                            for k, p, q in _children(data, x, y):
                                if k == CUE_TIME:
                                    time = number(p, q)
                                elif k == CUE_TRACK_POSITIONS:
                                    parts = {k: number(u, v) for k, u, v in _children(data, p, q)}
                                    yield "cues", (time * scale, parts.get(CUE_TRACK, 0), origin + parts.get(CUE_CLUSTER_POSITION, 0))
    except ValueError as fault:
        yield "error", (str(fault),)


def parse(data: bytes) -> tuple[list[tuple], list[tuple], str | None]:
    """(packets, cues, error) of a file: all that ``walk`` gives."""
    found: dict[str, list[tuple]] = {"packets": [], "cues": [], "error": []}
    for kind, row in walk(data):
        found[kind].append(row)
    return found["packets"], found["cues"], found["error"][0][0] if found["error"] else None


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, media) of rows (doc_id, bytes)."""
    for _, ids, texts in blocks(batches, 1 << 20):
        media = [write_pcm(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled with zeros to a positive multiple of 64, as a Matroska file.

    A null text counts as empty; repeated rows stay; other columns are dropped.
    """
    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(_write, "doc_id long, n_bytes long, media binary")


#: Rows of packets or cues that are handed on at once.
ROWS = 8192


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of the files in a binary column: the key and PACKETS. A null file has none; see ``walk`` for faults."""
    return _parsed(media, key, column, "packets", PACKETS)


def cues(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per cue of the files in a binary column: the key and CUE_ROWS."""
    return _parsed(media, key, column, "cues", CUE_ROWS)


def _parsed(media: DataFrame, key: str, column: str, wanted: str, shape: str) -> DataFrame:
    """(key, *shape): rows are handed on as they are read, whatever the number of files or the packets of one."""
    arrow = to_arrow_type(media.schema[key].dataType)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return read_rows(batches, wanted, shape, arrow)

    return media.select(F.col(key).alias("key"), F.col(column)).mapInArrow(read, f"key {media.schema[key].dataType.simpleString()}, {shape}").withColumnRenamed("key", key)


def read_rows(batches: Iterator[pa.RecordBatch], wanted: str, shape: str, arrow: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, *shape) of the wanted rows of the files in batches (key, file), ROWS at a time."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*((n, kinds[t]) for n, t in (x.split() for x in shape.split(", "))), strict=True)
    keys: list = []
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, arrow), *(pa.array(c, t) for c, t in zip(zip(*out), types, strict=True))], ["key", *names])

    for batch in batches:
        for key, file in zip(*batch.columns, strict=True):
            own = key.as_py()
            for kind, row in walk(file.as_py() or b""):
                if kind == wanted:
                    keys.append(own)
                    out.append(row)
                    if len(out) == ROWS:
                        yield table()
                        keys, out = [], []
    if out:
        yield table()


def document_packets(docs: DataFrame) -> DataFrame:
    """``packets`` of ``to_media`` in one pass: files are read where they are written, a few at a time."""
    return _written(docs, "packets", PACKETS)


def document_cues(docs: DataFrame) -> DataFrame:
    """``cues`` of ``to_media`` in one pass."""
    return _written(docs, "cues", CUE_ROWS)


def _written(docs: DataFrame, wanted: str, shape: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["key", "media"]) for b in _write(batches))
        return read_rows(files, wanted, shape, pa.int64())

    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(run, f"key long, {shape}").withColumnRenamed("key", "doc_id")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_clusters long, n_cues long, error string"


def digests(media: DataFrame) -> DataFrame:
    """What reading each stored file back gives: its packets, joined in order, and features of container and samples.

    One row per row of media, as DIGEST describes. The payload is rebuilt from the parsed byte ranges alone.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string()}
        names, types = zip(*((n, kinds[t]) for n, t in (x.split() for x in DIGEST.split(", "))), strict=True)
        for batch in batches:
            out = []
            for doc_id, n_bytes, data in rows([batch], 64):
                got, marks, fault = parse(data)
                payload = b"".join(data[p : p + n] for *_, p, n in got)
                clusters, lacings = len({p[0] for p in got}), sorted({p[4] for p in got})
                last = max((p[2] for p in got), default=0)
                feature = f"tracks={len({p[1] for p in got})};clusters={clusters};packets={len(got)};cues={len(marks)};lacing={'/'.join(map(str, lacings))};last_ns={last};low={min(payload, default=0)};high={max(payload, default=0)};mean={sum(payload) / max(1, len(payload)):.4f}"
                out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(got), clusters, len(marks), fault))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], list(names))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, DIGEST)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """``digests`` of ``to_media``: one row per document."""
    return digests(to_media(docs))
