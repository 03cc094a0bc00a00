"""Near-duplicates, repeated passages, media, packing, pieces, token counts and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readloom.llm import induced, matroska, packing, pieces, simhash, suffix_dedup, token_counts
from readloom.llm.common import cut
from readloom.llm.components import components
from readloom.llm.queries import vocabulary

from .conftest import ODD


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def groups(values, near):
    """The least index of each value's class under a relation."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(values))]


def fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(sample, odd):
    for frame in (sample[0], odd):
        rows = sorted(pairs(frame), key=lambda r: (r[0] is None, r[0] or 0))
        prints = [fingerprint(t) for _, t in rows]
        first = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
        want = sorted((str(k), f"{p:016x}", str(rows[i][0])) for (k, _), p, i in zip(rows, prints, first))
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(frame).collect()) == want
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    for similar in (False, True):
        assert simhash.keep_one(odd.limit(0), similar=similar).collect() == []
        assert simhash.keep_one(odd, similar=similar).columns == odd.columns
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len({*map(str, groups([fingerprint(t) for _, t in pairs(odd)], lambda a, b: (a ^ b).bit_count() <= 2))})


def test_pipeline_drops_near_copies_by_shingles(spark):
    import corpus_pipeline

    rnd = random.Random(5)
    words = ["".join(rnd.choice("etaonrish") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    texts = []
    for _ in range(12):
        text = [rnd.choice(words) for _ in range(120)]
        texts.append(" ".join(text))
        for near in ((30,), (10, 80), (10, 30, 50, 70, 90)):  # the last are not similar enough
            texts.append(" ".join("changed" if i in near else w for i, w in enumerate(text)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    first = groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert 12 < len(set(first)) < len(texts)
    prints = [fingerprint(t) for t in texts]
    assert len(set(groups(prints, lambda a, b: (a ^ b).bit_count() <= 2))) > len(set(first))  # two bits miss some
    frame = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert {r.doc_id for r in corpus_pipeline.unlike(spark, frame, "").collect()} == set(first)


def cluster(seed=1):
    rng = np.random.default_rng(seed)
    found = {0, (1 << 64) - 1, 1 << 63}
    for base in [0, 1 << 63, *(int(x) for x in rng.integers(0, 1 << 63, 20))]:
        for _ in range(15):
            x = base
            for _ in range(rng.integers(1, 5)):
                x ^= 1 << int(rng.integers(64))
            found.add(x)
    return sorted(found)


def near_halves(seed=2):
    """Many fingerprints that share a half but for a bit, as those of a large group of near copies do."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 63))
    found = {base}
    for _ in range(700):
        x = base ^ (1 << int(rng.integers(32)))
        for _ in range(rng.integers(0, 6)):
            x ^= 1 << int(rng.integers(32, 64))
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("prints", [cluster(), near_halves()], ids=["clusters", "near halves"])
def test_links_keep_classes(spark, prints):
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in components(simhash.links(frame)).collect()}
    got = [root.get(x, x) for x in signed]
    want = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("held, piece", [(1 << 24, 1 << 16), (200, 7), (3000, 64)])
def test_suffixes(held, piece, monkeypatch):
    """Order and common prefixes against brute force; small bounds make queues, logs and tables go to disk, and the recursion go deep."""
    monkeypatch.setattr(induced, "PIECE", piece)
    rng = np.random.default_rng(0)
    for k, n, kind, depth in itertools.product((1, 2, 30), (1, 2, 17, 300), ("random", "periodic", "flat"), (5, 20, 1000)):
        text = np.append(rng.integers(1, k + 1, n), 0).astype(np.int32)
        if kind == "periodic":
            text[:-1] = np.resize(text[: max(1, n // 3)], n)
        elif kind == "flat" and n > 10:
            text[3 : 3 + n // 2] = text[3]
        got = np.concatenate([np.zeros(0, induced.ENTRY), *induced.suffixes(text, k + 1, depth, held)])
        plain, pos = text.tolist(), got["pos"].tolist()
        assert sorted(pos) == list(range(n))
        heads = [plain[i : i + depth] for i in pos]
        assert all(x >= y for x, y in itertools.pairwise(heads))
        common = [sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))) for x, y in itertools.pairwise(heads)]
        assert got["lcp"].tolist() == [0, *common]


def test_shard_larger_than_memory(monkeypatch):
    """A shard of many times the bound on what each of its tables, logs and queues holds is sorted within a few times that bound."""
    import tracemalloc

    rng = np.random.default_rng(1)
    monkeypatch.setattr(induced, "PIECE", 1024)
    held, n = 16 << 10, 2600
    base = rng.integers(97, 123, 400).astype(np.uint8).tobytes()
    texts = [base[(a := int(rng.integers(200))) : a + 100] + rng.integers(97, 123, int(rng.integers(0, 60))).astype(np.uint8).tobytes() for _ in range(n)]
    assert sum(map(len, texts)) > 20 * held
    tracemalloc.start()
    shard = suffix_dedup.Shard(100, held)
    for i in range(0, n, 50):
        some = texts[i : i + 50]
        shard.add(np.full(len(some), 7), np.arange(i, i + len(some)), np.zeros(len(some), np.int64), np.array(list(map(len, some))), b"".join(some))
    spans = [[] for _ in range(n)]
    for row, start, end in shard.covered():
        for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
            spans[r].append((a, b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * held  # some dozens of tables, logs and queues
    got = [sum(b - a for a, b in suffix_dedup.runs(s)) for s in spans]
    assert got == [r[1] for r in without_repeats([t.decode() for t in texts])]


def without_repeats(rows, width=100):
    """(n_bytes, n_removed, n_spans, hash of the rest) of texts in order."""
    seen = set()
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if data[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            else:
                seen.add(data[i : i + width])
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        yield len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(data, gone) if not x)).hexdigest()


def repetitive(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("ab") for _ in range(400))
    texts = [(base[(a := rnd.randrange(300)) : a + rnd.randrange(90, 400)] + "é" * rnd.randrange(3) + base[: rnd.randrange(150)]) * rnd.randrange(1, 3) for _ in range(40)]
    return texts + ["z" * 1000, "z" * 150, None, "", "q" * 99, "q" * 99, "long " * 2000, base, base]


def test_suffix_dedup(spark, sample, odd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    made = cut(spark.createDataFrame(list(enumerate(repetitive(4))), "doc_id long, text string").repartition(4))
    for frame in (made, sample[0]):
        rows = sorted(pairs(frame))
        want = dict(zip((k for k, _ in rows), without_repeats([t for _, t in rows])))
        assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()} == want
    assert len(suffix_dedup.repeats(odd).collect()) == len(ODD)
    assert suffix_dedup.repeats(odd.limit(0)).collect() == []


def test_suffix_dedup_cuts_crowded_anchors(spark, monkeypatch):
    """A line in very many contexts, whose fragments go to shards by what is around it; some contexts agree in part."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rnd = random.Random(5)
    word = lambda n, letters="abcdefghijk ": "".join(rnd.choice(letters) for _ in range(n))
    lines = [word(size) for size in (70, 98, 101, 240)]
    texts = [word(rnd.randrange(60)) + word(rnd.randrange(4), "xy") + rnd.choice(lines) + word(rnd.randrange(4), "xy") + word(rnd.randrange(60)) for _ in range(300)]
    rows = list(enumerate(texts + [rnd.choice(lines) * 2, "é" + lines[1] * 3, None, ""]))
    frame = cut(spark.createDataFrame([(k, t) for k, t in rows] + [(None, lines[3])], "doc_id long, text string").repartition(4))
    want = dict(zip((k for k, _ in [*rows, (None, 0)]), without_repeats([t for _, t in rows] + [lines[3]])))
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeats(frame).collect()} == want


def test_shards_of_a_bucket_are_bounded(monkeypatch):
    """A bucket of many times the size of a shard is dealt to many of them, and so is an anchor in very many contexts."""
    rnd = random.Random(6)
    line = "".join(rnd.choice("abcdefghijk ") for _ in range(110))
    texts = [("".join(rnd.choice("lmnop") for _ in range(90)) + line + "".join(rnd.choice("lmnop") for _ in range(90))).encode() for _ in range(600)]
    f = suffix_dedup.Fragments(list(range(600)), texts, 100)
    kinds = np.unique(f.hash, return_counts=True)
    crowd = np.flatnonzero(f.hash == kinds[0][np.argmax(kinds[1])])
    assert len(crowd) >= 600
    answers, _ = suffix_dedup.compare([suffix_dedup.framed(suffix_dedup.pack_sorted(f.hash), *suffix_dedup._columns(f.mark.view(np.int64), f.doc, f.nth, f.first))], 500)
    code = np.frombuffer(suffix_dedup.unsqueeze(answers[0]), np.uint8)
    assert set(code[crowd]) <= {suffix_dedup.CROWDED, suffix_dedup.COVERED} and (code == suffix_dedup.CROWDED).sum() >= 500
    pieces = suffix_dedup.Pieces(f, f.firsts[code[f.firsts] == suffix_dedup.CROWDED], texts, 100)
    assert max(np.unique(pieces.hash[pieces.firsts], return_counts=True)[1]) < 100
    # as one pile
    pile, sizes = suffix_dedup.Pile(100, 1 << 14), pieces.last - pieces.first + 100
    x = pieces.firsts
    data = [texts[n][a : a + s] for n, a, s in zip(pieces.nth[x], pieces.first[x], sizes[x])]
    for i in range(0, len(x), 100):
        some, joined = x[i : i + 100], b"".join(data[i : i + 100])
        pile.add(suffix_dedup.keyed(pieces.hash[some], pieces.doc[some], pieces.nth[some], pieces.first[some], sizes[some], joined), np.frombuffer(joined, np.uint8))
    sorted_bytes = []
    add = suffix_dedup.Shard.add
    monkeypatch.setattr(suffix_dedup.Shard, "add", lambda self, *some: (sorted_bytes.append(len(some[-1])), add(self, *some)))
    piles = pile.deal(20_000)
    assert sum(p.size for p in piles) == pile.size > 10 * 20_000 and max(p.size for p in piles) < 60_000
    spans = {}
    for found in [(pieces.nth[pieces.again], pieces.first[pieces.again], (pieces.last + 100)[pieces.again]), *(s for p in piles for s in p.covered())]:
        for n, a, b in zip(*(v.tolist() for v in found)):
            spans.setdefault(n, []).append((a, b))
    got = [sum(b - a for a, b in suffix_dedup.runs(spans.get(n, []))) for n in range(600)]
    whole = suffix_dedup.Shard(100)
    y = f.firsts[code[f.firsts] == suffix_dedup.CROWDED]
    cuts = [texts[n][a : z + 100] for n, a, z in zip(f.nth[y], f.first[y], f.last[y])]
    whole.add(f.doc[y], f.nth[y], f.first[y], np.array(list(map(len, cuts))), b"".join(cuts))
    spans = {}
    for found in whole.covered():
        for n, a, b in zip(*(v.tolist() for v in found)):
            spans.setdefault(n, []).append((a, b))
    assert got == [sum(b - a for a, b in suffix_dedup.runs(spans.get(n, []))) for n in range(600)] and sum(got) > 0
    assert sum(sorted_bytes) < pile.size


def test_suffix_dedup_keeps_columns_and_characters(spark, odd):
    rnd = random.Random(1)
    text = "".join(rnd.choice("éüx") for _ in range(300))
    frame = spark.createDataFrame([(1, text, 9), (2, "ab" + text[1:] + "cd", 9), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(frame).collect()}
    assert got[1].text == text and got[1].n_chars == 300 and got[3].text is None and got[3].n_chars is None
    assert got[2].text == "abcd" and got[2].n_chars == 4
    again = suffix_dedup.without_repeats(odd)
    assert again.columns == odd.columns and again.count() == len(ODD)
    assert suffix_dedup.without_repeats(odd.limit(0)).collect() == []


def test_blocks_that_change_are_refused(spark, sample):
    """A table that gives other rows in the second pass fails the job, rather than giving wrong results."""
    from readloom.llm.exchange import REQUESTS, answer, meet
    from readloom.llm.common import block_rows, utf8

    scan = sample[0].select("doc_id", utf8())
    requests = spark.createDataFrame([(0, 0, 12345, b"x")], REQUESTS)
    with pytest.raises(Exception, match="other rows"):
        meet(answer(requests, lambda got: (got, [])), block_rows(scan), lambda got, block: block.select(["block"]), "block long").collect()


@pytest.mark.parametrize("n", [64, 512, 513, 4096, 4097, 65536, 70001])
def test_matroska_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = matroska.write_pcm(payload)
    packets, cues, fault = matroska.parse(data)
    assert fault is None and b"".join(data[p[5] : p[5] + p[6]] for p in packets) == payload
    assert [p[2] for p in packets] == [64_000_000 * i for i in range(len(packets))]  # frames of 512 samples at 8 kHz
    assert all(data[c[2] : c[2] + 4] == matroska.CLUSTER.to_bytes(4, "big") for c in cues)


def test_matroska_rows_are_handed_on_as_they_are_read(spark, odd):
    files = [matroska.write_pcm(bytes(n)) for n in (64, 30_000, 6_000_000)] + [None, b"", b"\0junk"]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f], pa.binary())], ["key", "media"]) for i, f in enumerate(files)]
    got = list(matroska.read_rows(iter(batches), "packets", matroska.PACKETS, pa.int64()))
    assert [b.num_rows for b in got] == [matroska.ROWS, 11719 + 59 + 1 - matroska.ROWS]
    want = [(i, *row) for i, f in enumerate(files) for row in matroska.parse(f or b"")[0]]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want
    media = matroska.to_media(odd)
    order = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert order(matroska.document_packets(odd)) == order(matroska.packets(media))
    assert order(matroska.document_cues(odd)) == order(matroska.cues(media))
    assert "MapInArrow" in (plan := matroska.document_packets(odd)._jdf.queryExecution().toString()) and "Generate" not in plan


def test_large_groups_of_near_copies_give_no_square_of_pairs(spark):
    rnd = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(400):
        words = list(base)
        words[rnd.randrange(400)] = f"own{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"u{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(200)]
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    prints = simhash._marks(docs, "doc_id", "text", 5, 3).withColumnRenamed("key", "node").drop("digest")
    pairs, crowded = simhash.similar_pairs(prints)
    assert pairs.count() < 400 * 399 // 8
    assert crowded.count() >= 400
    classes = {r.doc_id: r.first for r in simhash.similar_classes(docs, "doc_id").collect()}
    assert classes == {i: 0 if i < 400 else i for i in range(600)}


def test_pairs_left_out_are_found_across_classes(spark):
    rnd = random.Random(7)
    rows = []
    for _ in range(30):
        prints = [rnd.getrandbits(64) for _ in range(3)]
        for _ in range(rnd.choice([1, 2, 5, 90])):
            near = list(prints)
            for _ in range(rnd.randrange(40)):
                near[rnd.randrange(3)] ^= 1 << rnd.randrange(64)
            rows.append((len(rows), *(x - (x >> 63 << 64) for x in near)))
    nodes = cut(spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long"))
    whole = {tuple(sorted(p)) for p in simhash.pairs_across(nodes.withColumn("class", F.col("node"))).collect()}  # each a class of its own: all pairs
    bits = [sum((x & (1 << 64) - 1) << 64 * k for k, x in enumerate(r[1:])) for r in rows]

    def meet(d):
        return d.bit_count() <= simhash.SIMILAR_DISTANCE and any((d >> 16 * s & 0xFFFF).bit_count() <= 1 for s in range(12))

    assert whole == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if meet(bits[i] ^ bits[j])}
    pairs, crowded = simhash.similar_pairs(nodes)
    found, left = {tuple(sorted(p)) for p in pairs.collect()}, {r.node for r in crowded.collect()}
    assert found <= whole and all(i in left and j in left for i, j in whole - found)


def test_pairs_across_are_ruled_out_by_bins_only_if_unlike(spark):
    """A group of texts that are alike in fingerprints but too unlike in shingles gives few pairs; none that is similar is lost."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rnd.sample(range(150), 1 if i % 2 else 6):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    docs = cut(spark.createDataFrame([*enumerate(texts), (300, "")], "doc_id long, text string").repartition(3))
    nodes = cut(simhash._marks(docs, "doc_id", "text", 5, 3).withColumnRenamed("key", "node").drop("digest").withColumn("class", F.col("node")))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    similar = lambda p: 5 * len(sets[p[0]] & sets[p[1]]) >= 4 * len(sets[p[0]] | sets[p[1]])
    whole = {tuple(sorted(p)) for p in simhash.pairs_across(nodes).collect()}
    found = {tuple(sorted(p)) for p in simhash.pairs_across(nodes.join(simhash._binned(docs, "doc_id", "text", 5), F.col("node") == F.col("at")).drop("at")).collect()}
    want = set(filter(similar, whole))
    assert want and want <= found <= whole
    assert len(found - want) < len(whole - want) / 4


def test_nearest_of_a_long_run_gives_a_row_for_each_node():
    """A node's pair tells also that the node is to be compared once more; only nodes without a pair take a row of their own."""
    n = 2 * simhash.LONG_RUN
    got = list(simhash._nearest(np.zeros(n, np.int64), np.arange(n), np.arange(n), lambda i, j: np.arange(len(i))))
    assert sum(len(b) for _, b, _ in got) == n
    assert sorted(x for _, b, more in got for x in b[more].tolist()) == list(range(n))


def test_a_large_group_of_unlike_texts_gives_few_rows(spark, monkeypatch):
    """Texts that are alike in fingerprints but too unlike in shingles give a row for a variant, not for each of them under each variant."""
    rnd = random.Random(10)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        words = list(base)
        for at in rnd.sample(range(150), 1 if i < 40 else 7):
            words[at] = f"own{i}x{at}"
        texts.append(" ".join(words))
    docs = cut(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    made = []
    monkeypatch.setattr(simhash, "cut", lambda df: made.append(cut(df)) or made[-1])
    classes = {r.doc_id: r.first for r in simhash.similar_classes(docs, "doc_id").collect()}
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    want = groups(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    assert [classes[i] for i in range(400)] == want and 300 < len(set(want)) < 400
    assert sum(df.count() for df in made if df.columns == ["a", "b", "more"]) < 20 * 400


def test_full_bins_rule_out_nothing():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 60_000, np.int64).astype(np.uint64)
    sets = [np.unique(s) for s in (x, x[:58_000], x[:30_000], x[:1], x[:0])]
    bins = np.array([np.minimum(np.bincount((s % np.uint64(simhash.BINS)).astype(np.int64), minlength=simhash.BINS), simhash.FULL) for s in sets], np.uint8)
    i, j = map(np.array, zip(*itertools.combinations_with_replacement(range(5), 2)))
    possible = simhash._alike(bins, i, j, (4, 5))
    for a, b, p in zip(i, j, possible):
        both = len(np.intersect1d(sets[a], sets[b]))
        assert p or 5 * both < 4 * (len(sets[a]) + len(sets[b]) - both)
    assert not possible[(i == 2) & (j == 3)][0]


def test_matroska_forms():
    element, number = matroska._element, matroska._number
    lace = lambda kind, frames: b"\x81\0\x05" + bytes([kind << 1]) + matroska._laced(frames, kind)
    frames = [b"a" * 300, b"b", b"c" * 700, b"d"]
    body = number(matroska.TIMESTAMP, 1000) + element(matroska.BLOCK_GROUP, element(matroska.BLOCK, lace(matroska.XIPH, frames)) + number(matroska.REFERENCE_BLOCK, 1))
    body += element(matroska.SIMPLE_BLOCK, lace(matroska.EBML_LACING, frames))
    unknown = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body  # unknown size
    data = element(matroska.EBML, b"") + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + element(matroska.CLUSTER, number(matroska.TIMESTAMP, 7) + element(matroska.SIMPLE_BLOCK, lace(0, [b"z"])))
    packets, _, fault = matroska.parse(data)
    assert fault is None and [data[p[5] : p[5] + p[6]] for p in packets] == [*frames, *frames, b"z"]
    assert packets[0][:4] == (0, 1, 1005 * 1_000_000, False) and packets[-1][:3] == (1, 1, 12 * 1_000_000)
    for cut in range(len(data)):
        matroska.parse(data[:cut])  # a cut-off file gives what was read
    assert matroska.parse(b"") == ([], [], None) and matroska.parse(b"\0junk")[2]


def test_media_columns(spark, odd):
    got = matroska.media_round_trip(odd).collect()
    want = sorted((str(k), len(b := (t or "").encode()), hashlib.sha256(p := b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")).hexdigest(), zlib.crc32(p[-64:])) for k, t in pairs(odd))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    media = matroska.to_media(odd)
    files = sorted((str(r.doc_id), len(r.media), hashlib.sha256(r.media).hexdigest()) for r in media.collect())
    assert sorted((str(r.doc_id), r.media_bytes, r.media_sha256) for r in got) == files
    features = {r.payload_sha256: dict(x.split("=") for x in r.feature.split(";")) for r in got}
    for _, text in pairs(odd):
        payload = (b := (text or "").encode()).ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        f, frames = features[hashlib.sha256(payload).hexdigest()], -(-len(payload) // 512)
        assert (int(f["low"]), int(f["high"]), f["mean"]) == (min(payload), max(payload), f"{sum(payload) / len(payload):.4f}")
        assert (int(f["packets"]), int(f["last_ns"]), f["tracks"]) == (frames, 64_000_000 * (frames - 1), "1")
    total = matroska.packets(media).agg(F.sum("size")).first()[0]
    assert total == sum(r.payload_bytes for r in got)
    assert matroska.cues(media).count() == sum(r.n_cues for r in got)
    assert matroska.media_round_trip(odd.limit(0)).collect() == []
    assert matroska.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_decompose():
    for n in range(0, 9000, 7):
        parts = packing.decompose(n, 1024)
        assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and parts == sorted(parts, reverse=True)
        assert len(set(parts) - {1024}) == len([p for p in parts if p < 1024])


def test_packing(sample, odd):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame in (sample[0].limit(60), odd):
        pieces_ = packing.pack(frame, path, with_ids=True).collect()
        assert len({r.sequence_id for r in pieces_}) == len(pieces_) and all(r.offset == 0 and r.length == 1 << r.bucket for r in pieces_)
        texts = []
        for r in sorted(pieces_, key=lambda r: r.sequence_id):
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            texts = texts + [b""] if r.start == 0 else texts
            texts[-1] += bytes(r.ids)
        want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in pairs(frame)]
        assert sorted(texts) == sorted(want)
    assert packing.pack(odd.limit(0), path).collect() == []
    with pytest.raises(ValueError):
        packing.pack(odd, path, longest=1000)


def test_token_counts(sample, odd):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    for frame in (sample[0], odd):
        want = sorted((str(k), len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t in pairs(frame))
        assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in token_counts.count_tokens(frame, path).collect()) == want
    assert token_counts.count_tokens(odd.limit(0), path).collect() == []


def test_tokenizer_is_read_once_in_a_worker(spark):
    """Buckets and tasks of a worker share one tokenizer: at most one is read for each worker."""
    path = vocabulary("byte_bpe_50k.json")

    def same(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_counts.pre_tokens(path) is token_counts.pre_tokens(path)] * batch.num_rows)], ["same"])

    assert all(r.same for r in spark.range(8).mapInArrow(same, "same boolean").collect())


def test_pieces(sample, odd):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame in (sample[0], odd):
        coded = pieces.encode(frame, path)
        want = sorted((str(k), len((t or "").encode()), np.array(library.encode(t or ""), "<u4").tobytes()) for k, t in pairs(frame))
        assert sorted((str(r.doc_id), r.n_bytes, bytes(r.ids)) for r in coded.collect()) == want
        trips = [(str(r.doc_id), r.n_bytes, r.n_ids, r.ids_crc32) for r in pieces.round_trips(frame, path).collect()]
        assert sorted(trips) == sorted((k, n, len(ids) // 4, zlib.crc32(ids)) for k, n, ids in want)
        texts = sorted((str(r.doc_id), r.text) for r in pieces.decode(coded, path).collect())
        assert texts == sorted((str(k), (t or "").replace("▁", " ")) for k, t in pairs(frame))
        assert {r.round_trip for r in pieces.round_trips(frame, path).collect() if "▁" not in (dict(pairs(frame)).get(r.doc_id) or "")} == {True}
    assert pieces.encode(odd.limit(0), path).collect() == []


def test_unigram_pieces():
    rnd = random.Random(1)
    names = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3))) for _ in range(25)} | {"a", "▁", "▁a"}
    model = pieces.PieceModel([("<unk>", 0.0, pieces.UNKNOWN), *((p, -8 * rnd.random(), pieces.NORMAL) for p in sorted(names))], pieces.UNIGRAM)
    encoder = pieces.Encoder(model)
    words = {"▁" + "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 7))) for _ in range(200)}
    encoder.learn(words)

    def best(word):
        if not word:
            return 0.0
        ends = [best(word[:-n]) + model.scores[model.ids[word[-n:]]] for n in range(1, len(word) + 1) if word[-n:] in model.ids]
        return max(ends + ([best(word[:-1]) + model.lowest] if word[-1] not in model.ids else []))

    for word in words:
        ids = np.frombuffer(encoder.known[word], "<u4").tolist()
        assert abs(sum(model.scores[i] if i else model.lowest for i in ids) - best(word)) < 1e-9


def test_pipeline(spark, sample, tmp_path):
    import corpus_pipeline

    docs, folder = sample[0], "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "SimHash near-dedup", "suffix-array dedup", "packing"]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == before.columns
            assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    last = spark.read.parquet(str(tmp_path / "3"))
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in last.collect()}
    deduped = sorted(pairs(spark.read.parquet(str(tmp_path / "2"))))
    cut = {k: x for (k, _), x in zip(deduped, without_repeats([t for _, t in deduped]))}
    for r in last.collect():
        n_bytes, n_removed, *_ = cut[r.doc_id]
        assert n_bytes - n_removed <= len(r.text.encode()) <= n_bytes - n_removed + 6 * cut[r.doc_id][2] and r.n_chars == len(r.text)
    prints = [fingerprint(t) for _, t in deduped]
    assert all((a ^ b).bit_count() > 2 for a, b in itertools.combinations(prints, 2))
    import os

    ran = corpus_pipeline.run(spark, folder)
    assert in_order(ran) == in_order(docs)
    place = os.path.dirname(ran.inputFiles()[0]).removeprefix("file://")
    assert os.listdir(os.path.dirname(place)) == [os.path.basename(place)]  # nothing else is left of the run


def test_pipeline_of_nothing(spark, odd, sample, tmp_path):
    """Empty tables, and tables of odd rows, go through all stages."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {"none": spark.createDataFrame([], kinds), "odd": odd.select("doc_id", "text", "source", "n_chars")}
    for name, docs in tables.items():
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        sample[1].limit(0 if name == "none" else 100).write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}


def in_order(pieces_):
    return sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces_.collect())
