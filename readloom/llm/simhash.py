"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree in one 32-bit half but for at most one bit, and then in one third
of the other half. So each distinct fingerprint is indexed under every half with one bit struck out, together with every third
of the other half, equal keys are joined, and pairs are verified in full. Every pair is taken under one key only, and a bucket
gives no more links than it has fingerprints.

Near copies by word shingles (``similar_classes``) differ in far more bits. They are found by three fingerprints of longer shingles
in 16-bit segments under one-wildcard variants, and every pair found is verified by the Jaccard similarity of its shingle sets.
A variant under which some meet is told by one row. With those that are there go counts of their shingles in bins, which rule out
most pairs before they are made: two sets share no more than the lesser counts of all bins. At first each takes the nearest only;
what these leave open is compared between the classes that they make.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from readloom.llm.common import blocks, cut, sized, steady, utf8
from readloom.llm.components import components

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Near copies: words of a shingle, least Jaccard similarity as a fraction of whole numbers, fingerprints of 64 bits, and of all these bits how many may differ.
SIMILAR_SHINGLE, SIMILARITY, PRINTS, SIMILAR_DISTANCE = 5, (4, 5), 3, 52
#: Bins in which the shingles of a set are counted, in a byte each; FULL stands for that many or more.
BINS, FULL = 128, 255
#: The other half of a fingerprint in thirds, as (first bit, mask).
THIRDS = ((0, 0x7FF), (11, 0x7FF), (22, 0x3FF))
#: Rows under one variant beyond which near copies are told apart only once their links have made classes of them.
LONG_RUN = 64
#: Segments with their values under which some meet that may be broadcast, a long each; there are at most 12 * 65,536.
BROADCAST_PLACES = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many of each run of 64-bit hashes have each bit set: one row of 64 counts for each run; runs may be empty."""
    pieces = -(-sizes // 255)  # eight bits at a time are added in the eight bytes of a word, up to 255 hashes
    run = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = (np.cumsum(sizes) - sizes)[run] + 255 * nth
    out = np.zeros((len(sizes), 64), np.int64)
    if len(starts):
        firsts = (np.cumsum(pieces) - pieces)[pieces > 0]
        for s in range(8):
            lanes = np.add.reduceat(hashes >> np.uint64(s) & _LANES, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
            out[pieces > 0, s::8] = np.add.reduceat(lanes, firsts, axis=0)
    return out


def shingles(text: bytes, n: int) -> list[int]:
    """Hashes of all runs of n words; a text of fewer words has its whole sequence as its one shingle, one without words has none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) >= n else [b" ".join(words)] if words else []
    return [xxh64_intdigest(g, SEED) for g in grams]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes, signed."""
    bits = 2 * bit_counts(hashes, sizes) > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0].view(np.int64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of every row of docs; fp is the fingerprint as a signed long.

    Words are parted by ASCII white space after lower-casing A-Z; a text of fewer words than a shingle has its whole sequence
    as its one shingle. Texts without words, and nulls, have fingerprint zero.
    """
    kind = docs.schema[key].dataType.simpleString()
    arrow = to_arrow_type(docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in blocks(batches, 2 << 20):
            hashes: list[int] = []
            sizes = []
            for t in texts:
                grams = shingles(t, shingle)
                hashes += grams
                sizes.append(len(grams))
            fp = majority(np.array(hashes, np.uint64), np.array(sizes, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array(fp)], ["key", "fp"])

    return docs.select(F.col(key), utf8(text)).mapInArrow(run, f"key {kind}, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(key, fp): the one-wildcard variants of the halves of each fingerprint, each with the three thirds of the other half."""
    x, v = F.col("x"), F.expr("x div 3")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    struck = F.when(v < 32, low).otherwise(high).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, cast((x div 3) % 32 as int))")))
    other = F.when(v < 32, high).otherwise(low)
    third = F.get(F.array(*(F.shiftrightunsigned(other, at).bitwiseAND(F.lit(mask)) for at, mask in THIRDS)), F.expr("x % 3"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(n, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.lit(191))).alias("x"))
    return spread.select((x.cast("long") * (1 << 43) + third * (1 << 32) + struck).alias("key"), "fp")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut so that rows of one key, the first column, stay together."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and new[0][-1] == held[0][0][0]:
            held.append(new)
            continue
        whole = [np.concatenate(c) for c in zip(*held, new)]
        last = int(np.searchsorted(whole[0], whole[0][-1]))
        if last:
            yield [c[:last] for c in whole]
        held = [[c[last:] for c in whole]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _bit(x: np.ndarray) -> np.ndarray:
    """The place of the single set bit of each number; 0 for zero."""
    return np.where(x > 0, np.bitwise_count(x - np.minimum(x, x.dtype.type(1))), 0)


def _links(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of the links within runs of equal keys."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    at, lag = np.flatnonzero(keys[1:] == keys[:-1]), 1
    while len(at):
        diff = (fps[at] ^ fps[at + lag]).view(np.uint64)
        near = np.bitwise_count(diff) <= DISTANCE
        low, high = diff[near] & np.uint64(0xFFFFFFFF), diff[near] >> np.uint64(32)
        first = np.bitwise_count(low) <= 1
        other = np.where(first, high, low)
        third = np.stack([other >> np.uint64(a) & np.uint64(mask) for a, mask in THIRDS]).argmin(axis=0)  # the first that agrees
        own = 3 * np.where(first, _bit(low), 32 + _bit(np.where(first, np.uint64(0), high))) + third == keys[at[near]] >> 43
        for i in at[near][own].tolist():
            p, q = root(int(fps[i])), root(int(fps[i + lag]))
            if p != q:
                parent[p] = q
                out.append((int(fps[i]), int(fps[i + lag])))
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
    return out


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints of (fp) that connect all those within DISTANCE bits of each other."""
    sides = variants(distinct)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in whole_runs(batches):
            found = _links(keys, fps)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return cut(sides.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, first): first is the least key among all rows whose fingerprints links reach, itself included.

    Null keys are never first unless a class has no other. Repeated rows stay and are of one class.
    """
    marked = cut(fingerprints(docs, key, text))
    distinct = marked.groupBy("fp").agg(F.min("key").alias("first"))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    firsts = rooted.groupBy("root").agg(F.min("first").alias("least")).withColumnRenamed("root", "of")
    named = rooted.join(firsts, F.col("root") == F.col("of")).select(F.col("fp").alias("of_fp"), F.col("least").alias("first"))
    return marked.join(named, F.col("fp") == F.col("of_fp")).select(F.col("key").alias(key), "fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs: the fingerprint as 16 hexadecimal digits, and the first of ``classes``."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _marks(docs: DataFrame, key: str, text: str, shingle: int, prints: int) -> DataFrame:
    """(key, digest, f0, f1, ...) of every row: a digest of its set of shingles and fingerprints of that set."""
    names = [f"f{i}" for i in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for _, ids, texts in blocks(batches, 2 << 20):
            sets = [np.unique(np.array(shingles(t, shingle), np.uint64)) for t in texts]
            hashes, sizes = np.concatenate(sets), np.array(list(map(len, sets)), np.int64)
            digests = [xxh3_128_digest(h.tobytes()) for h in sets]
            found = []
            for _ in names:
                found.append(pa.array(majority(hashes, sizes)))
                hashes = _mixed(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), *found], ["key", "digest", *names])

    return docs.select(F.col(key), utf8(text)).mapInArrow(run, ", ".join(["key long, digest binary", *(f"{f} long" for f in names)]))


def _binned(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(at, bins) of every row: how many of its set of shingles are in each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in blocks(batches, 2 << 20):
            sets = [np.unique(np.array(shingles(t, shingle), np.uint64)) for t in texts]
            bins = [np.minimum(np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bins, pa.binary())], ["at", "bins"])

    return docs.select(F.col(key), utf8(text)).mapInArrow(run, "at long, bins binary")


def _alike(bins: np.ndarray, i: np.ndarray, j: np.ndarray, share: tuple) -> np.ndarray:
    """Which pairs may have the Jaccard similarity share, by the counts in their bins; none that has it is left out."""
    out = [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 14):
        a, b = bins[i[at : at + (1 << 14)]], bins[j[at : at + (1 << 14)]]
        least = np.minimum(a, b)
        both, sizes = least.sum(axis=1, dtype=np.int64), a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
        out.append(((share[0] + share[1]) * both >= share[0] * sizes) | (least.max(axis=1) == FULL))
    return np.concatenate(out)


def _own(differing: list[np.ndarray]) -> np.ndarray:
    """The first variant of ``similar_pairs`` that fingerprints share, by the bits in which they differ."""
    parts = np.stack([d >> np.uint64(16 * s) & np.uint64(0xFFFF) for d in differing for s in range(4)], axis=1)
    segment = (np.bitwise_count(parts) <= 1).argmax(axis=1)
    return 16 * segment + _bit(parts[np.arange(len(parts)), segment])


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, class, f0, f1, ...) of the nodes under each variant: a 16-bit segment with one bit struck out."""
    names = [c for c in nodes.columns if c not in ("node", "class", "bins")]
    more = ["bins"] if "bins" in nodes.columns else []
    v = F.col("v")
    part = F.expr(f"shiftright(array({', '.join(names)})[cast(v / 64 as int)], 16 * (cast(v / 16 as int) % 4)) & 65535L & ~shiftleft(1L, v % 16)")
    return nodes.select("node", "class", *names, *more, F.explode(F.sequence(F.lit(0), F.lit(64 * len(names) - 1))).alias("v")).select((v * 65536 + part.cast("int")).alias("key"), "node", "class", *names, *more)


def _met(keyed: DataFrame, compared: Callable[..., Iterator[tuple]], distance: int, share: tuple) -> DataFrame:
    """(a, b, more): what compared gives for the rows of ``_keyed`` that meet under a variant: those that agree in a 16-bit segment but for at most one bit.

    With a column bins, pairs that these tell to have less than the Jaccard similarity share are not near.
    """
    names = [c for c in keyed.columns if c not in ("key", "node", "class", "bins")]
    more = ["bins"] if "bins" in keyed.columns else []
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def near(keys: np.ndarray, prints: list[np.ndarray], bins: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are within distance bits, belong to the key under which they meet, and may be similar by their bins."""
        differing = [p[i] ^ p[j] for p in prints]
        found = np.flatnonzero(sum(np.bitwise_count(d).astype(np.int32) for d in differing) <= distance)
        found = found[_own([d[found] for d in differing]) == keys[i[found]] >> 16] if len(found) else found
        return found if bins is None else found[_alike(bins, i[found], j[found], share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, node, of, *columns in whole_runs(batches):
            prints = [p.view(np.uint64) for p in columns[: len(names)]]
            bins = np.frombuffer(b"".join(columns[-1]), np.uint8).reshape(-1, BINS) if more else None
            for a, b, left in compared(keys, node, of, partial(near, keys, prints, bins)):
                if len(b):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()) if a is None else pa.array(a), pa.array(b), pa.array(left)], ["a", "b", "more"])

    return cut(keyed.repartition(n, "key").sortWithinPartitions("key", "class").mapInArrow(run, "a long, b long, more boolean"))


def _some(keys: np.ndarray, node: np.ndarray, of: np.ndarray, near: Callable) -> Iterator[tuple]:
    """(None, key, more): the keys of runs in which any two rows are near; runs that are too long to look for these count as such."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    run, end = np.repeat(np.arange(len(first)), sizes), np.repeat(first + sizes, sizes)
    some = sizes > LONG_RUN
    i, lag = np.arange(len(keys)), 1
    i = i[~some[run] & (i + lag < end)]
    while len(i):
        some[run[i[near(i, i + lag)]]] = True
        lag += 1
        i = i[~some[run[i]] & (i + lag < end[i])]
    yield None, keys[first[some]].astype(np.int64), np.ones(np.count_nonzero(some), bool)


def _nearest(keys: np.ndarray, node: np.ndarray, of: np.ndarray, near: Callable) -> Iterator[tuple]:
    """(nearest, node, more): of each row the nearest earlier one of its run that is near, if there is one. more: rows of any other such pair; in runs that are too long to look for these, all rows but those that nothing is near."""
    at = np.arange(len(keys))
    start = np.maximum.accumulate(np.where(np.append(True, keys[1:] != keys[:-1]), at, 0))
    long = np.bincount(start, minlength=len(keys))[start] > LONG_RUN
    mate, paired, more = at.copy(), np.zeros(len(keys), bool), long.copy()
    j, lag = at[start < at], 1
    while len(j):
        found = j[near(j - lag, j)]
        again = found[paired[found]]
        more[again] = more[again - lag] = True
        new = found[~paired[found]]
        paired[new] = True
        mate[new] = new - lag
        lag += 1
        j = j[(j - lag >= start[j]) & ~(long[j] & paired[j])]
    end = np.append(np.flatnonzero(start == at)[1:], len(keys))[np.cumsum(start == at) - 1]
    i, lag = np.flatnonzero(long & ~paired), 1
    more[i] = False
    i = i[i + lag < end[i]]
    while len(i):  # those without an earlier row that is near may have a later one
        more[i[near(i, i + lag)]] = True
        lag += 1
        i = i[~more[i] & (i + lag < end[i])]
    yield node[mate[paired]], node[paired], more[paired]
    alone = np.unique(node[more & ~paired])
    yield None, alone, np.ones(len(alone), bool)


def _across(keys: np.ndarray, node: np.ndarray, of: np.ndarray, near: Callable) -> Iterator[tuple]:
    """All pairs of near rows of a run that are of different classes; rows are sorted by class."""
    run = np.append(True, keys[1:] != keys[:-1])
    own = run | np.append(True, of[1:] != of[:-1])
    end = np.append(np.flatnonzero(run)[1:], len(keys))[np.cumsum(run) - 1]
    j = np.append(np.flatnonzero(own)[1:], len(keys))[np.cumsum(own) - 1]  # the first row of the next class
    i = np.flatnonzero(j < end)
    j = j[i]
    while len(i):
        found = near(i, j)
        yield node[i[found]], node[j[found]], np.zeros(len(found), bool)
        j = j + 1
        i, j = i[j < end[i]], j[j < end[i]]


def similar_pairs(nodes: DataFrame, distance: int = SIMILAR_DISTANCE, share: tuple = SIMILARITY, binned: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """((a, b), (node)): pairs of the nodes (node, f0, f1, ...) within distance bits that agree in a 16-bit segment but for at most one bit, and nodes.

    A node has at most one pair with an earlier one under each variant, so that a group of like nodes gives no square of pairs;
    both nodes of any pair that is left out for this are among the nodes, for ``pairs_across``. binned gives (at, bins) of some
    nodes (node); pairs that these tell to be less similar than share are left out and count for nothing. Nodes must be the same
    when read again. A variant under which some meet is one row, and nodes are found by the segments that these stand for.
    """
    own = nodes.withColumn("class", F.col("node"))
    places = _met(_keyed(own), _some, distance, share).select(F.explode(F.expr("array(0L, shiftleft(1L, cast(b div 65536 % 16 as int)))")).alias("bit"), "b").select(F.expr("b div 1048576 * 65536 + (b % 65536 | bit)").alias("place")).distinct()
    names = [c for c in nodes.columns if c != "node"]
    segments = F.array(*(F.expr(f"{4 * n + s} * 65536 + (shiftright({f}, {16 * s}) & 65535L)") for n, f in enumerate(names) for s in range(4)))
    meet = nodes.select("node", F.explode(segments).alias("place")).join(sized(places, BROADCAST_PLACES), "place", "left_semi").select("node").distinct()
    met = cut(own.join(meet, "node", "left_semi"))
    if binned:
        met = met.join(binned(met.select("node")), F.col("node") == F.col("at")).drop("at")
    found = _met(_keyed(met), _nearest, distance, share)
    return found.where("a is not null").select("a", "b"), found.where("more").select(F.col("b").alias("node")).distinct()


def pairs_across(nodes: DataFrame, distance: int = SIMILAR_DISTANCE, share: tuple = SIMILARITY) -> DataFrame:
    """(a, b): all such pairs of the nodes (node, class, f0, f1, ...) that are of different classes; with a column bins, without those that it tells to be less similar than share."""
    return _met(_keyed(nodes), _across, distance, share).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, shingle: int = SIMILAR_SHINGLE, share: tuple = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of keys of docs whose sets of shingles, known by 64-bit hashes, have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in blocks(batches, 2 << 20):
            sets = [np.unique(np.array(shingles(t, shingle), np.uint64)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(docs.join(wanted, F.col(key) == F.col("node"), "left_semi").select(key, utf8(text)).mapInArrow(run, "node long, hashes array<long>"))
    of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"of_{end}"))
    s, t = F.size("of_a"), F.size("of_b")
    joined = pairs.join(of("a"), "a").join(of("b"), "b").where(share[1] * F.least(s, t) >= share[0] * F.greatest(s, t))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return joined.where(share[1] * both >= share[0] * (s + t - both)).select("a", "b")


def similar_classes(docs: DataFrame, key: str, text: str = "text", shingle: int = SIMILAR_SHINGLE, share: tuple = SIMILARITY, prints: int = PRINTS, distance: int = SIMILAR_DISTANCE) -> DataFrame:
    """(key, first): first is the least key among the rows that equal sets of shingles and verified pairs reach. Keys are distinct longs."""
    marked = cut(_marks(docs, key, text, shingle, prints))
    names = [f"f{i}" for i in range(prints)]
    nodes = cut(marked.groupBy("digest").agg(F.min("key").alias("node"), *(F.min(f).alias(f) for f in names)))
    plain = nodes.drop("digest")
    binned = lambda some: _binned(docs.join(some, F.col(key) == F.col("node"), "left_semi"), key, text, shingle)
    pairs, crowded = similar_pairs(plain, distance, share, binned)
    roots = components(verified(pairs, docs, key, text, shingle, share))
    classed = plain.join(crowded, "node", "left_semi").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    classed = classed.join(binned(crowded), F.col("node") == F.col("at"))
    across = pairs_across(classed.select("node", "class", *names, "bins"), distance, share)
    if not across.isEmpty():  # what links copies besides those that each has next to it
        more = verified(across, docs, key, text, shingle, share)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    roots = roots.withColumnRenamed("node", "of")
    named = nodes.join(roots, F.col("node") == F.col("of"), "left").select("digest", F.coalesce("root", "node").alias("first"))
    return marked.select("key", "digest").join(named, "digest").select(F.col("key").alias(key), "first")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """The rows of docs but for near-duplicates: of each class the row of the least doc_id stays, of repeated rows one. docs must give the same rows when read again.

    Classes are those of ``classes``, or with similar those of ``similar_classes``.
    """
    rowed = steady(docs).withColumn("__row", F.monotonically_increasing_id())
    found = (similar_classes if similar else classes)(rowed.select("__row", text), "__row", text)
    order = F.struct(F.col(key).isNull(), F.col(key), "__row")
    ids = found.join(rowed.select("__row", key), "__row")
    kept = ids.groupBy("first").agg(F.min(order).alias("o")).select(F.col("o.__row").alias("__kept"))
    return rowed.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")

