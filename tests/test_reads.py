"""Codecs, keys, projections, datasets, FASTQ, temporary datasets and workflows."""

import random
import struct
import time

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from readloom import errors
from readloom.functions import codecs, keys, text
from readloom.operators import fields, workflows
from readloom.plans.fixtures import generated
from readloom.sources import fastq
from readloom.sources.reads import adapted, local_records, reader, writer
from readloom.sources.temp import TempDataset
from readloom.streaming.transcode import stream_reads, stream_transcoded

ALL_BYTES = bytes(range(256))


def one(spark, values, column, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r.x for r in frame.select("i", column(F.col("s")).alias("x")).orderBy("i").collect()]


SEQUENCES = ["", "G", "ACGTACGT", "ACNGTRYACGT", "NNNNNN", "acgtNacgt", "ACGT" * 8, "ACGT" * 8 + "A", "ACGTRYn" * 40, "A" * 600]


@pytest.mark.parametrize("name", ["raw", "two_bit_exact", "run_length", "two_bit_lossy_n", "omitted", "upper"])
def test_sequence_codecs(spark, name):
    upper = lambda s: s.translate(str.maketrans("acgt", "ACGT"))
    want = {"raw": lambda s: s, "run_length": lambda s: s, "two_bit_exact": upper, "omitted": lambda s: "", "upper": str.upper, "two_bit_lossy_n": lambda s: "".join(c if c in "ACGT" else "N" for c in upper(s))}[name]
    assert one(spark, SEQUENCES, codecs.codec("sequence", name).round_trip) == [want(s) for s in SEQUENCES]


def test_sizes(spark):
    size = lambda n: one(spark, SEQUENCES, codecs.codec("sequence", n).size)
    odd = [sum(c not in "ACGTacgt" for c in s) for s in SEQUENCES]
    assert size("two_bit_exact") == [8 * -(-len(s) // 32) + 4 + 5 * a for s, a in zip(SEQUENCES, odd)]
    assert size("two_bit_lossy_n") == [8 * -(-len(s) // 32) + 4 + 4 * a for s, a in zip(SEQUENCES, odd)]
    assert size("omitted") == [0] * len(SEQUENCES)


def test_binning_of_all_bytes(spark):
    (once,) = one(spark, [ALL_BYTES], text.on_bytes(codecs.binned), "binary")
    (twice,) = one(spark, [bytes(once)], text.on_bytes(codecs.binned), "binary")
    assert once == twice and len(once) == 256 and min(once) == 33
    assert [once[33 + p] - 33 for p in (0, 1, 2, 5, 9, 10, 15, 25, 34, 35, 39, 40, 93)] == [0, 0, 6, 6, 6, 15, 15, 27, 33, 37, 37, 40, 40]


def test_all_bytes_pass_the_text_layer(spark):
    assert bytes(one(spark, [ALL_BYTES], text.on_bytes(lambda c: c), "binary")[0]) == ALL_BYTES
    packed = text.on_bytes(codecs.codec("sequence", "two_bit_exact").round_trip)
    assert bytes(one(spark, [ALL_BYTES], packed, "binary")[0]) == ALL_BYTES.translate(bytes.maketrans(b"acgt", b"ACGT"))


def test_names(spark):
    names = ["a:b:c 1:N:0:X", "plain", "", "id p1 p2", "id ", " x"]
    assert one(spark, names, codecs.codec("name", "split").round_trip) == ["a:b:c 1:N:0:X", "plain", "", "id p1 p2", "id", " x"]
    parts = one(spark, names, codecs.split_name)
    assert [tuple(p) for p in parts] == [("a:b:c", "1:N:0:X"), ("plain", ""), ("", ""), ("id", "p1 p2"), ("id", ""), ("", "x")]


def reverse_complement(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def packed(s):
    n = 0
    for c in s.upper():
        n = 4 * n + "ACGT".index(c)
    return n


def kmers(s, k):
    return [min(packed(s[i : i + k]), packed(reverse_complement(s[i : i + k]))) for i in range(len(s) - k + 1)]


def test_prefix_kmers(spark):
    assert one(spark, ["ACGTGAAAA", "CACGTTTTT", "ACG", "ACGTNAAAA", "acgtg", None], lambda c: keys.prefix_kmer(c, 5)) == [110, 110, None, None, 110, None]
    long = ["G" + "A" * 30 + "C", "C" * 32, "ACGT" * 8]
    assert [int(x) for x in one(spark, long, lambda c: keys.prefix_kmer(c, 32))] == [kmers(s, 32)[0] for s in long]
    assert bytes(one(spark, ["ACGTGAAAA"], lambda c: keys.little_endian(keys.prefix_kmer(c, 5)))[0]) == (110).to_bytes(8, "little")


@pytest.mark.parametrize("k,w", [(5, 7), (31, 15), (1, 1), (32, 3)])
def test_minimizers(spark, k, w):
    rnd = random.Random(k)
    reads = ["".join(rnd.choice("ACGTacgt") for _ in range(n)) for n in (0, 3, k, k + w - 2, k + w - 1, 90, 200)] + ["ACGTN" * 20]
    want = [None if len(s) < k + w - 1 or "N" in s else min(kmers(s, k)) for s in reads]
    got = [x if x is None else int(x) for x in one(spark, reads, lambda c: keys.minimizer(c, k, w))]
    assert got == want
    assert [x if x is None else int(x) for x in one(spark, [reverse_complement(s) for s in reads], lambda c: keys.minimizer(c, k, w))] == want


def test_byte_keys(spark):
    assert [bytes(x) for x in one(spark, [b"ACG", b"ACGTACGTAC"], keys.prefix_bytes, "binary")] == [b"ACG" + bytes(5), b"ACGTACGT"]

    def fold(s):
        out = bytearray(8)
        for i, b in enumerate(s):
            out[i % 8] ^= b
        return bytes(out)

    values = [b"", b"ACG", bytes(range(256))]
    assert [bytes(x) for x in one(spark, values, keys.xor_bytes, "binary")] == [fold(s) for s in values]


def test_xor_key_takes_eight_bytes_at_a_time(spark):
    values = [bytes(i * 7 % 251 for i in range(n)) for n in (0, 1, 7, 8, 9, 40, 97)] + [b"\xff" * 24, None]
    frame = spark.createDataFrame([(v,) for v in values], "v binary").coalesce(1)
    for width in (1, 3, 8, 12, 16):
        found = frame.select(keys.xor_bytes(F.col("v"), width).alias("k"))
        assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
        for value, got in zip(values, found.collect(), strict=True):
            want = bytearray(width)
            for i, b in enumerate(value or b""):
                want[i % width] ^= b
            assert bytes(got.k) == bytes(want)


def test_registries():
    with pytest.raises(errors.InvalidOption):
        codecs.codec("sequence", "nope")
    with pytest.raises(errors.InvalidOption):
        keys.register(keys.Key("bytes8", 8, given_tag="another-tag-16by"))
    with pytest.raises(errors.InvalidOption):
        keys.prefix_kmer(None, 33)


def test_fields():
    assert len(fields.PROJECTIONS) == 15
    assert fields.NAME | fields.KEY == fields.KEY | fields.NAME == fields.KEY | fields.NAME | fields.KEY
    assert (fields.KEY | fields.SEQUENCE).columns() == ["sequence", "key"]
    with pytest.raises(errors.InvalidOption):
        fields.fields("bogus")


@pytest.fixture
def reads(spark):
    rnd = random.Random(5)
    rows = [(bytes(rnd.randrange(256) for _ in range(rnd.randrange(40))), s := bytes(rnd.choice(b"ACGTNacgt") for _ in range(rnd.randrange(90))), b"!" * len(s), i.to_bytes(8, "big")) for i in range(40)]
    return spark.createDataFrame(rows, "name binary, sequence binary, quality binary, key binary")


def rows(frame, *names):
    return sorted(tuple(bytes(x) if isinstance(x, (bytes, bytearray)) else x for x in r) for r in frame.select(*names).collect())


def test_dataset_round_trip(spark, reads, tmp_path):
    path = str(tmp_path / "raw")
    writer().bytes8_key().target_block_records(7).save(reads, path)
    open_ = lambda: reader(spark).bytes8_key()
    assert rows(open_().load(path), *reads.columns) == rows(reads, *reads.columns)
    assert open_().select("sequence", "key").load(path).columns == ["sequence", "key"]
    assert open_().select(fields.KEY).select(fields.NAME | fields.QUALITY).load(path).columns == ["name", "quality"]
    assert "ReadSchema: struct<key:binary>" in open_().select("key").load(path)._jdf.queryExecution().toString()
    assert reader(spark).load(path).columns == ["name", "sequence", "quality"]
    assert sum(1 for _ in local_records(open_().load(path))) == 40
    with pytest.raises(AnalysisException):
        reader(spark).load(path).select("key")
    with pytest.raises(errors.KeyMismatch):
        reader(spark).bytes16_key().load(path)
    with pytest.raises(errors.CodecMismatch):
        reader(spark).two_bit_exact().load(path)
    with pytest.raises(errors.MissingKey):
        reader(spark).select("key").load(path)


def test_compact_dataset(spark, reads, tmp_path):
    path = str(tmp_path / "compact")
    compact = lambda x: x.two_bit_exact().quality_codec("binned").name_codec("split")
    plain = reads.drop("key").where("name not like '% '")
    compact(writer()).save(plain, path)
    want = sorted((n[:-1] if n.find(b" ") == len(n) - 1 and n else n, s.translate(bytes.maketrans(b"acgt", b"ACGT")), q) for n, s, q in rows(plain, "name", "sequence", "quality"))
    assert rows(compact(reader(spark)).load(path), "name", "sequence", "quality") == want
    with pytest.raises(errors.MissingKey):
        reader(spark).two_bit_exact().quality_codec("binned").name_codec("split").bytes8_key().load(path)


def test_omitted_fields_are_empty_and_take_no_column(spark, reads, tmp_path):
    path = str(tmp_path / "keys")
    writer().empty_payload().bytes8_key().save(reads, path)
    assert spark.read.parquet(path).columns == ["key"]
    got = reader(spark).empty_payload().bytes8_key().load(path)
    assert rows(got, "name", "sequence") == [(b"", b"")] * 40


def test_write_errors(spark, reads, tmp_path):
    bad = spark.createDataFrame([(b"bad", b"ACGT", b"!!!")], "name binary, sequence binary, quality binary")
    with pytest.raises(errors.LengthMismatch, match="differ in length: 4 and 3"):
        writer().save(bad, str(tmp_path / "a"))
    none = bad.withColumn("quality", F.lit(b""))
    for n, make in enumerate((writer, lambda: writer().quality_codec("binned"), lambda: writer().omit_names())):
        with pytest.raises(errors.LengthMismatch, match="4 and 0"):
            make().save(none, str(tmp_path / f"n{n}"))
    with pytest.raises(errors.LengthMismatch):  # both are there, though one is not kept
        writer().omit_quality().save(bad, str(tmp_path / "o"))
    writer().omit_quality().save(none, str(tmp_path / "p"))
    with pytest.raises(RuntimeError):
        writer().bytes8_key().save(none.withColumn("quality", F.lit(b"!!!!")).withColumn("key", F.lit(None).cast("binary")), str(tmp_path / "q"))
    with pytest.raises(errors.KeyWidth, match="8 bytes"):
        writer().bytes8_key().save(bad.withColumn("quality", F.lit(b"!!!!")).withColumn("key", F.lit(b"short")), str(tmp_path / "b"))
    with pytest.raises(errors.MissingKey):
        writer().save(reads, str(tmp_path / "c"))
    with pytest.raises(errors.MissingKey):
        writer().bytes8_key().save(reads.drop("key"), str(tmp_path / "d"))
    with pytest.raises(errors.InvalidOption):
        writer().options(target_bytes=5)
    with pytest.raises(ValueError):
        writer().empty_payload().save(reads.drop("key"), str(tmp_path / "e"))


def test_empty_dataset(spark, reads, tmp_path):
    writer().bytes8_key().save(reads.limit(0), str(tmp_path / "none"))
    assert reader(spark).bytes8_key().load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n, groups", [(None, [40]), (7, [7, 7, 7, 7, 7, 5]), (0, [1] * 40)])
def test_blocks_are_row_groups(reads, tmp_path, n, groups):
    import pyarrow.parquet as pq

    w = writer().bytes8_key()
    (w if n is None else w.target_block_records(n)).save(reads.coalesce(1), str(tmp_path / "x"))
    (path,) = (tmp_path / "x").glob("*.parquet")
    meta = pq.ParquetFile(path).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == groups


def test_long_reads_are_packed_in_linear_time(spark):
    import time

    rnd = random.Random(2)
    frame = spark.createDataFrame([(i, "".join(rnd.choice("ACGTN") if j % 50 == 0 else rnd.choice("ACGT") for j in range(8000))) for i in range(64)], "i int, sequence string").coalesce(1)
    start = time.perf_counter()
    got = frame.select("sequence", codecs.codec("sequence", "two_bit_exact").round_trip(F.col("sequence")).alias("again")).collect()
    assert all(r.sequence == r.again for r in got) and time.perf_counter() - start < 20


def test_window_minimizers(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ACGTacgt") for _ in range(n)) for n in (0, 3, 10, 11, 12, 40, 90)] + ["ACGTN" * 8]
    turn = str.maketrans("ACGT", "TGCA")

    def brute(s, k, w):
        if len(s) < k + w - 1 or set(s) - set("ACGTacgt"):
            return None
        value = lambda x: sum("ACGT".index(c) << 2 * i for i, c in enumerate(reversed(x)))
        kmers = [min(value(x), value(x[::-1].translate(turn))) for x in (s.upper()[i : i + k] for i in range(len(s) - k + 1))]
        return sorted({min(kmers[i : i + w]) for i in range(len(kmers) - w + 1)})

    got = spark.createDataFrame([(t,) for t in texts], "sequence string").select(keys.window_minimizers(F.col("sequence"), 5, 7).alias("m"), keys.minimizer(F.col("sequence"), 5, 7).alias("least")).collect()
    assert [r.m for r in got] == [brute(t, 5, 7) for t in texts]
    assert all(r.least == (r.m[0] if r.m else None) for r in got)


def test_window_minimizers_take_time_by_the_length_alone(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (300_000, 50)] + [None, "A" * 3004, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "sequence string").coalesce(1)
    start = time.perf_counter()
    got = [r.m for r in frame.select(keys.window_minimizers(F.col("sequence"), 5, 3000).alias("m")).collect()]
    assert time.perf_counter() - start < 20
    assert got[0][0] == min(kmers(texts[0], 5)) and got[1:] == [None, None, [0], None]


def test_keys_are_derived_once(spark):
    from readloom.plans.catalog import queries

    for name in ("key_scan", "keyed_reads", "external_sort"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5") <= 9


def test_sort_report(spark):
    frame = spark.createDataFrame([(i * 7 % 50,) for i in range(100)], "k int").repartition(5)
    assert tuple(workflows.sort_report(workflows.external_sort(frame, "k"), "k").first()) == (100, 50, 0, 0, 49)
    worse = workflows.sort_report(spark.range(9).select((8 - F.col("id")).alias("k")).repartitionByRange(1, "k").sortWithinPartitions(F.desc("k")), "k").first()
    assert (worse.n_rows, worse.falls, worse.first, worse.last) == (9, 8, 8, 0)
    assert workflows.sort_report(frame.limit(0), "k").first().n_rows == 0


def test_custom_codec_and_key(spark, reads, tmp_path):
    if ("quality", "reversed") not in codecs._CODECS:
        codecs.register(codecs.Codec("quality", "reversed", F.reverse, F.reverse, F.length, given_tag="test:qual:revers"))
        keys.register(keys.Key("twelve", 12, given_tag="test:key:twelve!"))
    frame = reads.withColumn("key", F.rpad("key", 12, b"x"))
    path = str(tmp_path / "custom")
    writer().quality_codec("reversed").record_key("twelve").save(frame, path)
    assert rows(reader(spark).quality_codec("reversed").record_key("twelve").load(path), *frame.columns) == rows(frame, *frame.columns)


def test_fastq_over_many_splits(spark, tmp_path):
    reads = generated(spark, 500).select("name", "sequence", "quality")
    path = str(tmp_path / "fq")
    fastq.write_fastq(reads.repartition(3), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7k")
    try:
        assert rows(fastq.read_fastq(spark, path), "name", "sequence", "quality") == rows(reads, "name", "sequence", "quality")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fastq_quality_may_start_with_at_and_bad_reads_fail(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r 1\nACGT\n+\n@!!@\n@r2\n\n+\n\n\n\n")
    assert rows(fastq.read_fastq(spark, str(tmp_path / "a.fq")), "name", "sequence", "quality") == [("r 1", "ACGT", "@!!@"), ("r2", "", "")]
    (tmp_path / "b.fq").write_text("@r\nACGT\n+\n!!\n")
    with pytest.raises(Exception, match="malformed read"):
        fastq.read_fastq(spark, str(tmp_path / "b.fq")).collect()


def test_records(spark, reads):
    plain = reads.drop("key")
    assert rows(fastq.from_records(fastq.to_records(plain), "record"), "name", "sequence", "quality") == rows(plain, "name", "sequence", "quality")
    cut_off = spark.createDataFrame([(b"\x05\0\0\0abc",)], "content binary")
    with pytest.raises(Exception):
        fastq.from_records(cut_off).collect()


def test_records_are_handed_on_many_at_once():
    record = lambda i: struct.pack("<I", 2) + b"%02d" % i + struct.pack("<I", 3) + b"ACG" + b"!!!"
    batches = [pa.RecordBatch.from_arrays([pa.array([record(i), None, b"", record(i) * 2], pa.binary())], ["record"]) for i in range(50)]
    got = list(fastq._parse(iter(batches)))
    assert len(got) == 1 and got[0].num_rows == 150
    assert got[0].column(0).to_pylist() == [b"%02d" % i for i in range(50) for _ in range(3)]


def test_adapters(spark):
    frame = spark.createDataFrame([("a", "AC", [0, 40])], "id string, seq string, scores array<int>")
    assert adapted(frame, "id", "seq", "scores", phred=True).collect() == [("a", "AC", "!I")]


def test_temp_dataset(spark, tmp_path):
    frame = spark.range(5)
    with TempDataset(spark, str(tmp_path)) as t:
        t.write(frame)
        t.write(frame)
        assert t.read().count() == 5
    assert not list(tmp_path.iterdir())
    t = TempDataset(spark, str(tmp_path))
    t.cleanup()
    t.cleanup()
    with TempDataset(spark, str(tmp_path)) as t:
        t.write(frame)
        (tmp_path / "taken").mkdir()
        with pytest.raises(errors.DestinationExists):
            t.persist(str(tmp_path / "taken"))
        kept = t.persist(str(tmp_path / "kept"))
    assert spark.read.parquet(kept).count() == 5
    a, b = TempDataset(spark, str(tmp_path)), TempDataset(spark, str(tmp_path))
    assert a.path != b.path


def test_workflows(spark, tmp_path):
    frame = spark.createDataFrame([("r1", "ACGT"), ("r2", "TCGT"), ("r3", "AAAA"), ("r4", "GCGT"), ("r5", "CCGT"), ("r6", "TTTT"), ("r7", "")], "name string, sequence string")
    counts = {r.bucket: r.n_reads for r in workflows.bucket_counts(frame, workflows.first_base_bucket()).collect()}
    assert counts == {0: 3, 1: 1, 2: 1, 3: 2}
    workflows.write_partitioned(frame, str(tmp_path / "p"), workflows.first_base_bucket())
    assert spark.read.parquet(str(tmp_path / "p")).where("bucket = 3").count() == 2
    numbered = spark.range(10).withColumn("k", 9 - F.col("id"))
    assert workflows.block_layout(numbered, "id", 0).count() == 10
    assert workflows.sort_violations(workflows.sorted_runs(numbered, 4, "id", "k"), "run", "place", "k").first()[0] == 0
    assert workflows.sort_violations(numbered.withColumn("run", F.lit(0)), "run", "id", "k").first()[0] == 9


def test_stream(spark, tmp_path):
    generated(spark, 200).select("name", "sequence", "quality").repartition(3).write.parquet(str(tmp_path / "in"))
    query = stream_transcoded(stream_reads(spark, str(tmp_path / "in"), 1), workflows.COMPACT, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    want = workflows.transcode(spark.read.parquet(str(tmp_path / "in")), workflows.COMPACT)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "name", "sequence", "quality") == rows(want, "name", "sequence", "quality")
