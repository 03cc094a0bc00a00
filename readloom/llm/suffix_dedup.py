"""Exact removal of passages of a fixed length that occur earlier in the corpus, by suffix arrays of shards.

Every window of WIDTH bytes has an anchor: the least-hashed gram in it. Equal windows have equal anchors, so blocks of
documents ask buckets of the hash space which anchors repeat; the stretch of text whose windows share an anchor is a fragment.
Of equal fragments all but the first are covered. Different fragments of a repeated anchor meet in a shard, whose suffixes are
sorted by induction in external memory; neighbours that agree in WIDTH bytes are equal windows, and all but the first of those
are covered. A shard streams into files of its task, so that it may be far larger than memory.

A shard of a few MB is sorted in memory, six times as fast as a larger one, so what a bucket gets is dealt to shards of at most
about SHARD bytes by its keys: the anchors. An anchor with more than HOT different fragments is not one key, as that would be the work of one task: its fragments are cut to
pieces of NEAR windows, by their distance from the anchor, and the key of a piece is what all its windows have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from readloom.llm.common import block_rows, block_texts, blocks, bucket_count, cut, rows, rows_digest, sized, slices, utf8
from readloom.llm.exchange import ANSWERS, REQUESTS, answer, framed, meet, pack_sorted, request_batch, squeeze, tabled, to_bucket, unframed, unpack_sorted, unsqueeze
from readloom.llm.induced import HELD, PIECE, Log, suffixes, table

WIDTH, GRAM = 100, 40
#: Bytes of text in a block, and of text whose grams are hashed at once.
BLOCK, STEP = 6 << 20, 1 << 20
#: Bytes of fragments that are sorted at once, but for a key that has more.
SHARD = 2 << 20
#: Different fragments of an anchor beyond which they are cut, and the windows of a piece.
HOT, NEAR = 2048, 4
FRAGMENT = np.dtype([("doc", "<i8"), ("row", "<i8"), ("first", "<i8"), ("size", "<i8")])
KEYED = np.dtype([*FRAGMENT.descr, ("key", "<u8"), ("mark", "<u8")])
#: A null doc_id comes after all others.
LAST = (1 << 63) - 1
OTHER, COVERED, SHARED, CROWDED = 0, 1, 2, 3


def anchors(data: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchor of each window of data."""
    n = len(data) - GRAM + 1
    part = lambda at: np.ndarray((n,), "<u8", data, at, (1,))
    h = part(0) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, GRAM, 8):
        h = (h ^ h >> np.uint64(29) ^ part(at)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    # least hash over each window by running minima of stretches as long as it, the leftmost of ties
    w = width - GRAM + 1
    key = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)
    m = n - w + 1
    key = np.append(key, np.full(-n % w, ~np.uint64(0))).reshape(-1, w)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    back = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return h[at], at


def fragments(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nth, first, last, place, hash, mark): stretches of windows with one anchor. nth: the text; first, last: starts of windows
    in it; place: of the anchor, from first; hash: of the anchor; mark: of the bytes of the stretch and the anchor's place in it."""
    from xxhash import xxh3_64_intdigest

    out = []
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        data = np.frombuffer(b"".join(t for *_, t in group), np.uint8)
        h, at = anchors(data, width)
        sizes = np.array([len(t) for *_, t in group])
        text = np.repeat(np.arange(len(group)), sizes)[: len(at)]
        ok = np.arange(len(at)) + width <= np.cumsum(sizes)[text]
        s = np.flatnonzero(ok)
        new = np.ones(len(s), bool)
        new[1:] = (text[s[1:]] != text[s[:-1]]) | (at[s[1:]] != at[s[:-1]])
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(s)) - 1
        a, b = s[firsts], s[lasts]
        base = np.cumsum(sizes) - sizes
        nth, origin = np.array([g[0] for g in group])[text[a]], np.array([g[1] for g in group])[text[a]] - base[text[a]]
        joined, place = data.tobytes(), at[a] - a
        mark = np.array([xxh3_64_intdigest(joined[x : y + width], z) for x, y, z in zip(a.tolist(), b.tolist(), place.tolist())], np.uint64)
        spread = (h[a] ^ h[a] >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)  # least hashes are small ones: deal them out evenly
        out.append((nth, a + origin, b + origin, place, spread ^ spread >> np.uint64(29), mark))

    held = 0
    for n, t in enumerate(texts):
        for i in range(0, max(0, len(t) - width + 1), STEP):  # a long text in parts; a stretch cut in two is two stretches
            piece = t[i : i + STEP + width - 1]
            group.append((n, i, piece))
            held += len(piece)
            if held >= STEP:
                flush()
                group, held = [], 0
    if group:
        flush()
    empty = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(empty, *out, strict=True))


class Fragments:
    """The fragments of a block: of equal ones only the first is kept (firsts), by rising hash; the others are covered (again)."""

    def __init__(self, ids: list, texts: list[bytes], width: int):
        nth, first, last, place, h, mark = fragments(texts, width)
        doc = np.array([LAST if i is None else i for i in ids], np.int64)[nth] if len(nth) else nth
        order = np.lexsort((first, nth, doc, mark, h))
        self.nth, self.first, self.last, self.place, self.hash, self.mark, self.doc = (x[order] for x in (nth, first, last, place, h, mark, doc))
        new = np.ones(len(nth), bool)
        new[1:] = (self.hash[1:] != self.hash[:-1]) | (self.mark[1:] != self.mark[:-1])
        self.firsts, self.again = np.flatnonzero(new), np.flatnonzero(~new)


class Pieces:
    """Some of the fragments of a block, cut to pieces of at most NEAR windows, with the keys of what these share; of equal pieces only the first is kept (firsts), the others are covered (again).

    Equal windows are equally far from their anchor, so they are in pieces of the same number, and all bytes that the windows of
    this number have in common are the same: they have one key.
    """

    def __init__(self, f: Fragments, some: np.ndarray, texts: list[bytes], width: int):
        from xxhash import xxh3_64_intdigest

        first, last, place = f.first[some], f.last[some], f.place[some]
        most = place // NEAR
        n = most - (place - (last - first)) // NEAR + 1
        of = np.repeat(np.arange(len(some)), n)
        number = most[of] - (np.arange(len(of)) - (np.cumsum(n) - n)[of])
        anchor = (first + place)[of]
        least, greatest = number * NEAR, number * NEAR + NEAR - 1  # bytes of a window before its anchor
        nth, doc = f.nth[some][of], f.doc[some][of]
        first, last = np.maximum(first[of], anchor - greatest), np.minimum(last[of], anchor - least)
        around = zip(nth.tolist(), (anchor - least).tolist(), (anchor + width - greatest).tolist(), number.tolist())
        key = np.array([xxh3_64_intdigest(texts[t][a:b], k) for t, a, b, k in around], np.uint64)
        mark = np.array([xxh3_64_intdigest(texts[t][a : b + width]) for t, a, b in zip(nth.tolist(), first.tolist(), last.tolist())], np.uint64)
        order = np.lexsort((first, nth, doc, mark, key))
        self.nth, self.first, self.last, self.hash, self.mark, self.doc = (x[order] for x in (nth, first, last, key, mark, doc))
        new = np.ones(len(order), bool)
        new[1:] = (self.hash[1:] != self.hash[:-1]) | (self.mark[1:] != self.mark[:-1])
        self.firsts, self.again = np.flatnonzero(new), np.flatnonzero(~new)


def _columns(*arrays: np.ndarray) -> list[bytes]:
    return [squeeze(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()) for a in arrays]


def _column(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]


def compare(payloads: list[bytes], hot: int = HOT) -> tuple[list[bytes], list[int]]:
    """For each fragment that blocks sent to a bucket: COVERED if an equal one comes earlier, SHARED if it is the first of its kind and its anchor has other kinds, CROWDED if that are more than hot kinds, else OTHER."""
    asked = [unframed(p) for p in payloads]
    hashes = [unpack_sorted(a[0]) for a in asked]
    sizes = [len(h) for h in hashes]
    h = np.concatenate(hashes)
    mark, doc, nth, first = (np.concatenate([_column(a[i]) for a in asked]) for i in range(1, 5))
    block = np.repeat(np.arange(len(asked)), sizes)
    order = np.lexsort((first, nth, block, doc, mark, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (mark[order[1:]] != mark[order[:-1]])
    _, group = np.unique(h[order], return_inverse=True)
    kinds = np.bincount(group[new])[group]
    code = np.zeros(len(h), np.uint8)
    code[order] = np.where(new, np.select([kinds > hot, kinds > 1], [CROWDED, SHARED], OTHER), COVERED)
    return [squeeze(c.tobytes()) for c in np.split(code, np.cumsum(sizes)[:-1])], []


class Shard:
    """Fragments of text on disk, with their documents and places, until their suffixes are sorted."""

    def __init__(self, width: int = WIDTH, held: int = HELD):
        self.width, self.held = width, held
        self.data, self.fragments = Log("u1", held), Log(FRAGMENT, held)

    def add(self, doc: np.ndarray, row: np.ndarray, first: np.ndarray, sizes: np.ndarray, data: bytes) -> None:
        """Fragments by their document, row of the input, first byte in it, and size, and their bytes one after another."""
        some = np.zeros(len(doc), FRAGMENT)
        some["doc"], some["row"], some["first"], some["size"] = doc, row, first, sizes
        self.fragments.put(some)
        self.data.put(np.frombuffer(data, np.uint8))

    def _tables(self) -> None:
        """The fragments joined by separators: 0 ends the text, 1 parts fragments, bytes are from 2 on."""
        n = self.fragments.count
        self.table, self.starts = table(n, FRAGMENT, self.held), table(n + 1, "<i8", self.held)
        at = total = 0
        for some in self.fragments.pieces():
            self.table[at : at + len(some)] = some
            ends = total + np.cumsum(some["size"] + 1)
            self.starts[at + 1 : at + 1 + len(some)] = ends
            at, total = at + len(some), int(ends[-1])
        self.text = table(total + 1, "<i2", self.held)
        at = 0  # bytes so far, without separators
        raw = table(n + 1, "<i8", self.held)
        raw[:] = np.asarray(self.starts) - np.arange(n + 1)
        for piece in self.data.pieces():
            for i in range(0, len(piece), PIECE):
                some = piece[i : i + PIECE]
                place = np.arange(at, at + len(some))
                self.text[place + np.searchsorted(raw, place, "right") - 1] = some.astype(np.int16) + 2
                at += len(some)
        self.text[np.asarray(self.starts[1:]) - 1] = 1

    def covered(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, start, end) of the spans covered by windows that an equal one precedes, in an earlier document, row or place."""
        self._tables()
        marked, best, fresh = table(len(self.text), "u1", self.held), None, True
        for entries in suffixes(self.text, 258, self.width, self.held):
            run = np.cumsum(entries["lcp"] < self.width)
            own = np.searchsorted(self.starts, entries["pos"], "right") - 1
            valid = entries["pos"] + self.width < np.asarray(self.starts[np.minimum(own + 1, len(self.starts) - 1)])
            run, pos, own = run[valid], entries["pos"][valid], own[valid]
            if best is not None:  # the first so far of the windows that may go on
                run, pos, own = np.append(0, run), np.append(best[0], pos), np.append(best[1], own)
            if not len(run):
                continue
            same = run[1:] == run[:-1]
            many = np.append(same, False) | np.append(False, same)
            last = run[-1]
            some = np.flatnonzero(many)
            about = self.table[own[some]]
            order = np.lexsort((about["first"] + pos[some] - self.starts[own[some]], about["row"], about["doc"], run[some]))
            some = some[order]
            later = np.zeros(len(some), bool)
            later[1:] = run[some[1:]] == run[some[:-1]]
            marked[pos[some[later]]] = 1
            firsts = some[~later]
            keep = firsts[-1] if len(firsts) and run[firsts[-1]] == last else len(run) - 1
            best = (pos[keep], own[keep])
            shift = np.count_nonzero(entries["lcp"] < self.width)
            if shift > last:  # what came last fits no window, so nothing goes on
                best = None
        for i in range(0, len(marked), 1 << 20):
            at = i + np.flatnonzero(marked[i : i + (1 << 20)])
            if not len(at):
                continue
            own = np.searchsorted(self.starts, at, "right") - 1
            head = np.ones(len(at), bool)
            head[1:] = (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])
            a = np.flatnonzero(head)
            b = np.append(a[1:], len(at)) - 1
            about = self.table[own[a]]
            base = about["first"] - self.starts[own[a]]
            yield about["row"], base + at[a], base + at[b] + self.width


class Pile:
    """Fragments of text with their keys, on disk beyond a bound, until they are dealt to shards."""

    def __init__(self, width: int = WIDTH, held: int = HELD):
        self.width, self.held, self.size = width, held, 0
        self.about, self.data = Log(KEYED, held), Log("u1", held)

    def add(self, about: np.ndarray, data: np.ndarray) -> None:
        """Fragments, and their bytes one after another."""
        self.about.put(about)
        self.data.put(data)
        self.size += len(data)

    def _parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return zip(self.about.pieces(), self.data.pieces(), strict=True)

    def deal(self, size: int) -> list[Pile]:
        """Piles of about size bytes, each with all fragments of its keys."""
        n = min(256, -(-self.size // size))
        if n <= 1:
            return [self]
        piles = [Pile(self.width, self.held // n) for _ in range(n)]
        for about, data in self._parts():
            to = (about["key"] % np.uint64(n)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            starts = (np.cumsum(about["size"]) - about["size"])[order]
            about, to = about[order], to[order]
            ends = np.cumsum(about["size"])
            data = data[np.repeat(starts - (ends - about["size"]), about["size"]) + np.arange(len(data))]
            found, heads = np.unique(to, return_index=True)
            for i, a, b in zip(found.tolist(), heads.tolist(), [*heads[1:].tolist(), len(to)]):
                piles[i].add(about[a:b], data[ends[a] - about["size"][a] : ends[b - 1]])
        return piles

    def covered(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, start, end) of covered spans: equal fragments but the first, and what a shard finds in fragments whose key has other kinds."""
        if not self.size:
            return
        about = np.concatenate(list(self.about.pieces()))
        order = np.lexsort((about["first"], about["row"], about["doc"], about["mark"], about["key"]))
        key, mark = about["key"][order], about["mark"][order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
        again = about[order[~new]]
        if len(again):
            yield again["row"], again["first"], again["first"] + again["size"]
        _, group = np.unique(key, return_inverse=True)
        keep = np.zeros(len(order), bool)
        keep[order] = new & (np.bincount(group[new])[group] > 1)
        if not keep.any():
            return
        shard, at = Shard(self.width, HELD), 0
        for about, data in self._parts():
            kept = keep[at : at + len(about)]
            at += len(about)
            if kept.any():
                some = about[kept]
                shard.add(some["doc"], some["row"], some["first"], some["size"], data[np.repeat(kept, about["size"])].tobytes())
        yield from shard.covered()


def keyed(key: np.ndarray, doc: np.ndarray, row: np.ndarray, first: np.ndarray, sizes: np.ndarray, data: bytes) -> np.ndarray:
    """Fragments for a pile."""
    from xxhash import xxh3_64_intdigest

    out = np.zeros(len(key), KEYED)
    ends = np.cumsum(sizes)
    out["key"], out["doc"], out["row"], out["first"], out["size"] = key, doc, row, first, sizes
    out["mark"] = [xxh3_64_intdigest(data[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    return out


def _shards(parts: DataFrame, width: int, size: int, held: int, n_buckets: int) -> DataFrame:
    """Answers to what parts sent to buckets: spans by block. Small buckets are joined; larger ones are dealt to shards of about size bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, at, marks = Pile(width, held), None, {}

        def done() -> Iterator[pa.RecordBatch]:
            found = [spans for part in pile.deal(size) for spans in part.covered()]
            if not found:
                return
            row, start, end = (np.concatenate(x) for x in zip(*found))
            known = np.array(sorted(marks))
            block = known[np.searchsorted(known, row, "right") - 1]
            order = np.argsort(block, kind="stable")
            row, start, end, block = row[order], start[order], end[order], block[order]
            some, heads = np.unique(block, return_index=True)
            for b, x, y in zip(some.tolist(), heads.tolist(), [*heads[1:].tolist(), len(block)]):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([marks[b]], pa.int64()), pa.array([at], pa.int32()), pa.array([framed(*_columns(row[x:y] - b, start[x:y], end[x:y]))], pa.binary()), pa.array([None], pa.list_(pa.int64()))], ["block", "digest", "bucket", "payload", "sums"])

        for bucket, block, mark, payload in rows(batches, 16):
            if bucket != at and pile.size >= size:
                yield from done()
                pile, marks = Pile(width, held), {}
            keys, *columns, data = unframed(payload)
            doc, nth, first, sizes = map(_column, columns)
            data = unsqueeze(data)
            pile.add(keyed(unpack_sorted(keys), doc, block + nth, first, sizes, data), np.frombuffer(data, np.uint8))
            at, marks[block] = bucket, mark
        yield from done()

    n = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_buckets // 4)
    dealt = parts.repartition(n, "bucket").sortWithinPartitions("bucket", "block").select("bucket", "block", "digest", "payload")
    return dealt.mapInArrow(run, ANSWERS)


def _spans(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(answers with the covered spans of blocks, block rows)"""
    n_buckets = bucket_count(docs)
    scan = docs.select(F.col("doc_id").cast("long"), utf8())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, BLOCK):
            f = Fragments(ids, texts, width)
            h = f.hash[f.firsts]
            found, starts = np.unique(to_bucket(h, n_buckets), return_index=True)
            out = {}
            for b, s, e in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(h)]):
                x = f.firsts[s:e]
                out[b] = framed(pack_sorted(h[s:e]), *_columns(f.mark[x].view(np.int64), f.doc[x], f.nth[x], f.first[x]))
            if out:
                yield request_batch(block, rows_digest(ids, list(map(len, texts))), out)

    def part(got: list[bytes], block: pa.Table) -> pa.Table:
        ids, texts = block_texts(block)
        f = Fragments(ids, texts, width)
        code = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(unsqueeze(a), np.uint8) for a in got)])
        done = np.concatenate([f.again, f.firsts[code == COVERED]])
        pieces = Pieces(f, f.firsts[code == CROWDED], texts, width)
        covered, shared = ((f, done), (pieces, pieces.again)), ((f, f.firsts[code == SHARED]), (pieces, pieces.firsts))
        payloads = {-1: framed(*_columns(*(np.concatenate(x) for x in zip(*((g.nth[x], g.first[x], g.last[x] + width) for g, x in covered)))))}
        key, doc, nth, first, last = (np.concatenate(x) for x in zip(*((g.hash[x], g.doc[x], g.nth[x], g.first[x], g.last[x]) for g, x in shared)))
        order = np.argsort(key, kind="stable")
        key, doc, nth, first, end = key[order], doc[order], nth[order], first[order], last[order] + width
        found, starts = np.unique(to_bucket(key, n_buckets), return_index=True)
        for b, s, e in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(key)]):
            data = b"".join([texts[n][a:z] for n, a, z in zip(nth[s:e].tolist(), first[s:e].tolist(), end[s:e].tolist())])
            payloads[b] = framed(pack_sorted(key[s:e]), *_columns(doc[s:e], nth[s:e], first[s:e], end[s:e] - first[s:e]), squeeze(data))
        return pa.Table.from_batches([request_batch(block["block"][0].as_py(), rows_digest(ids, list(map(len, texts))), payloads)])

    texts = block_rows(scan, BLOCK)
    parts = cut(meet(answer(scan.mapInArrow(ask, REQUESTS), lambda got: compare(got, HOT)), texts, part, REQUESTS))
    shards = _shards(parts.where("bucket >= 0"), width, SHARD, HELD, n_buckets)
    return shards.unionByName(parts.where("bucket < 0").select("block", "digest", "bucket", "payload", F.lit(None).cast("array<long>").alias("sums"))), texts


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _by_text(got: list[bytes]) -> dict[int, list[tuple[int, int]]]:
    """The runs of the texts of a block that have any, by place."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for data in got:
        for i, a, b in zip(*(_column(x).tolist() for x in unframed(data))):
            spans.setdefault(i, []).append((a, b))
    return {i: runs(s) for i, s in spans.items()}


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """REMOVED of every row of docs: the bytes covered by strings of width bytes that also start earlier, in a smaller doc_id or before in the same text.

    Matches are judged on the input and never cross texts. Null and shorter texts lose nothing; rows with a null doc_id come
    after all others; rows that share a doc_id come in the order of the scan, so all but the first of repeated rows lose all
    they have, if that is width bytes. Other columns are dropped. docs must give the same rows when read again.
    """

    def cut_out(got: list[bytes], block: pa.Table) -> pa.Table:
        ids, texts = block_texts(block)
        out, found = [], _by_text(got)
        for nth, (doc_id, text) in enumerate(zip(ids, texts)):
            spans = found.get(nth, [])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        return tabled([x.split()[0] for x in REMOVED.split(", ")], list(zip(*out)), [pa.int64()] * 4 + [pa.string()])

    answers, texts = _spans(docs, width)
    return meet(answers, texts, cut_out, REMOVED)


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """text without the whole characters of spans; a character that is not covered whole stays."""
    kept, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with shorter texts: whole characters of ``repeats`` are cut out of text, and n_chars follows. Other columns stay; a null text stays null.

    The runs to cut are known by the row; texts are shuffled only to meet them, or not at all where few rows have any.
    """
    spans, _ = _spans(docs.select("doc_id", "text"), width)
    names, at = docs.columns, docs.columns.index("text")
    schema = to_arrow_schema(docs.schema)

    def by_row(table: pa.Table) -> pa.Table:
        found = _by_text(table["payload"].to_pylist())
        first = table["block"][0].as_py()
        ends = [[[span[i] for span in spans] for spans in found.values()] for i in (0, 1)]
        return tabled(["__of", "__from", "__to"], [[first + i for i in found], *ends], [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, at):
            new = part.column(at).to_pylist()
            hit = pc.indices_nonzero(part.column(len(names)).is_valid()).to_pylist()
            starts, stops = (part.column(len(names) + i).to_pylist() for i in (0, 1))
            for i in hit:
                if new[i] is None or stops[i][-1] > len(texts[i]):
                    raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
                new[i] = _without(texts[i], list(zip(starts[i], stops[i])))
            columns = part.columns[: len(names)]
            columns[at] = pa.array(new, schema.field(at).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in new], schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = spans.where("block >= 0").groupBy("block").applyInArrow(by_row, "__of long, __from array<long>, __to array<long>")
    rowed = docs.withColumn("__row", F.monotonically_increasing_id())
    joined = rowed.join(sized(found), F.col("__row") == F.col("__of"), "left").select(*names, "__from", "__to")
    return joined.mapInArrow(cut_out, docs.schema)
