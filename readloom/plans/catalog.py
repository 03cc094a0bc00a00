"""The queries that this library registers over the reads view, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import codecs, keys, text
from readloom.operators import fields, workflows
from readloom.plans.fixtures import READS_SQL, generated, reads
from readloom.sources.fastq import from_records, read_fastq, to_fastq, to_records, write_fastq
from readloom.sources.reads import reader, writer
from readloom.sources.temp import TempDataset

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

C = F.col
UPPER = "translate(sequence, 'acgt', 'ACGT')"
EXACT, LOSSY = UPPER, f"regexp_replace({UPPER}, '[^ACGT]', 'N', 'g')"
N_ODD = "length(regexp_replace(sequence, '[ACGTacgt]', '', 'g'))"
WORDS = "8 * CAST(ceil(length(sequence) / 32.0) AS INT)"
_Q = "".join(chr(c) for c in range(33, 75))
_BINS = "".join(map(codecs.bin_of, range(33, 75)))
BINNED = "translate(quality, '{}', '{}')".format(*(x.replace("'", "''") for x in (_Q, _BINS)))
ID = "CASE WHEN instr(name, ' ') > 0 THEN substr(name, 1, instr(name, ' ') - 1) ELSE name END"
DESCRIPTION = "CASE WHEN instr(name, ' ') > 0 THEN substr(name, instr(name, ' ') + 1) ELSE '' END"
BUCKET = "CASE substr(sequence, 1, 1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END"


def _value(kmer: str, k: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, {k}), lambda i: CAST(instr('ACGT', substr({kmer}, CAST({k} - i AS INT), 1)) - 1 AS BIGINT) << (2 * i))) AS BIGINT)"


def _canonical(kmer: str) -> str:
    """The canonical k-mer as text: packed values are in the order of the texts."""
    return f"least({kmer}, translate(reverse({kmer}), 'ACGT', 'TGCA'))"


def _prefix(k: int) -> str:
    return _value(f"p{k}", k)


def _minimizer(k: int) -> str:
    return _value(f"m{k}", k)


def _kmers() -> str:
    """Columns with the canonical k-mers as text: of the prefix, and the least of all."""
    out = []
    for k in (31, 5):
        out.append(f"CASE WHEN regexp_matches(sequence, '^[ACGTacgt]{{{k}}}') THEN {_canonical(f'substr({UPPER}, 1, {k})')} END AS p{k}")
    for k, w in ((31, 15), (5, 7)):
        all_ = f"list_transform(range(1, CAST(length(sequence) AS BIGINT) - {k} + 2), lambda j: {_canonical(f'substr({UPPER}, CAST(j AS INT), {k})')})"
        out.append(f"CASE WHEN regexp_matches(sequence, '^[ACGTacgt]{{{k + w - 1},}}$') THEN list_min({all_}) END AS m{k}")
    return ", ".join(out)


def _keyed(key: str) -> str:
    return f"(SELECT *, {key} AS key FROM reads)"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = f"WITH plain AS ({READS_SQL.replace('{events}', 'events')}), reads AS (SELECT *, {_kmers()} FROM plain) {sql}"


def _column(name: str, column: Callable[[], Column], sql: str, alias: str) -> None:
    """A query of one computed column beside event_id. Columns are made when the query runs, as they need a session."""
    _add(name, lambda s, d: reads(s, d).select("event_id", column().alias(alias)), f"SELECT event_id, {sql} AS {alias} FROM reads")


def _with_prefix(s: SparkSession, d: str) -> DataFrame:
    """Reads with a key that may be null, as text."""
    return reads(s, d).withColumn("key", keys.prefix_kmer(C("sequence")).cast("string"))


def _register() -> None:
    # scans and projections
    keyed = _keyed(_prefix(31))
    _add("full_scan", reads, "SELECT event_id, name, sequence, quality FROM reads")
    for label, chosen in fields.PROJECTIONS.items():
        names = chosen.columns()
        _add(f"project_{label}", lambda s, d, chosen=chosen: fields.project(_with_prefix(s, d), chosen), f"SELECT {', '.join(names)} FROM {_keyed(f'CAST({_prefix(31)} AS VARCHAR)') if 'key' in names else 'reads'}")
    _add("key_scan", lambda s, d: fields.project(workflows.with_key(reads(s, d), "prefix_kmer"), fields.KEY), f"SELECT key FROM {keyed} WHERE key IS NOT NULL")
    _add("scan_total_lengths", lambda s, d: reads(s, d).agg(F.count("*").alias("n"), *(F.sum(F.length(c)).alias(f"{c}_bytes") for c in ("name", "sequence", "quality"))), "SELECT count(*) AS n, CAST(sum(length(name)) AS BIGINT) AS name_bytes, CAST(sum(length(sequence)) AS BIGINT) AS sequence_bytes, CAST(sum(length(quality)) AS BIGINT) AS quality_bytes FROM reads")
    _column("read_display", text.shown, "concat(name, chr(9), sequence, chr(9), '(', length(sequence), ' bp)')", "line")
    # predicates
    _add("length_mismatch", lambda s, d: reads(s, d).withColumn("quality", F.when(C("event_id") % 11 == 0, F.substring("quality", 2, 1000)).otherwise(C("quality"))).where(text.mismatched()).select("event_id"), "SELECT event_id FROM (SELECT event_id, sequence, CASE WHEN event_id % 11 = 0 THEN substr(quality, 2) ELSE quality END AS quality FROM reads) AS x WHERE length(sequence) <> length(quality)")
    _add("canonical_only", lambda s, d: reads(s, d).where(text.canonical()).select("event_id", "sequence"), "SELECT event_id, sequence FROM reads WHERE regexp_matches(sequence, '^[ACGTacgt]*$')")
    _add("keyed_reads", lambda s, d: workflows.with_key(reads(s, d), "prefix_kmer").select("event_id", "name", "key"), f"SELECT event_id, name, key FROM {keyed} WHERE key IS NOT NULL")
    # sequence codecs
    trip = lambda field, name: lambda: codecs.codec(field, name).round_trip(C(field))
    _column("seq_raw", trip("sequence", "raw"), "sequence", "sequence")
    _column("seq_omitted", trip("sequence", "omitted"), "''", "sequence")
    _column("seq_two_bit_exact", lambda: codecs.two_bit_exact(C("sequence")), EXACT, "sequence")
    _column("seq_two_bit_lossy_n", lambda: codecs.two_bit_lossy_n(C("sequence")), LOSSY, "sequence")
    _column("seq_two_bit_exact_packed", trip("sequence", "two_bit_exact"), EXACT, "sequence")
    _column("seq_two_bit_lossy_n_packed", trip("sequence", "two_bit_lossy_n"), LOSSY, "sequence")
    _column("seq_upper", trip("sequence", "upper"), "upper(sequence)", "sequence")
    _column("seq_rle_round_trip", trip("sequence", "run_length"), "sequence", "sequence")
    _column("seq_rle_size", lambda: codecs.codec("sequence", "run_length").size(C("sequence")).cast("long"), "CAST(2 * (1 + list_sum(list_transform(range(2, CAST(length(sequence) AS BIGINT) + 1), lambda i: CASE WHEN substr(sequence, CAST(i AS INT), 1) <> substr(sequence, CAST(i - 1 AS INT), 1) THEN 1 ELSE 0 END))) AS BIGINT)", "bytes")
    _column("ambiguity_sideband", lambda: F.array_join(F.transform(codecs.sideband(C("sequence")), lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), x["base"])), ","), "coalesce(list_aggregate(list_transform(list_filter(range(1, CAST(length(sequence) AS BIGINT) + 1), lambda i: instr('ACGTacgt', substr(sequence, CAST(i AS INT), 1)) = 0), lambda i: concat(i - 1, ':', substr(sequence, CAST(i AS INT), 1))), 'string_agg', ','), '')", "odd")
    sizes = {"raw": "length(sequence)", "two_bit_exact": f"{WORDS} + 4 + 5 * {N_ODD}", "two_bit_lossy_n": f"{WORDS} + 4 + 4 * {N_ODD}"}
    _add("encoded_sizes", lambda s, d: reads(s, d).select("event_id", *(codecs.codec("sequence", n).size(C("sequence")).cast("long").alias(n) for n in sizes), codecs.codec("quality", "binned").size(C("quality")).cast("long").alias("binned"), codecs.codec("name", "split").size(C("name")).cast("long").alias("split")), f"SELECT event_id, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in sizes.items())}, CAST(length(quality) AS BIGINT) AS binned, CAST(4 + length(name) - CASE WHEN instr(name, ' ') > 0 THEN 1 ELSE 0 END AS BIGINT) AS split FROM reads")
    # quality and name codecs
    _column("qual_raw", trip("quality", "raw"), "quality", "quality")
    _column("qual_binned", trip("quality", "binned"), BINNED, "quality")
    _column("qual_omitted", trip("quality", "omitted"), "''", "quality")
    _column("name_raw", trip("name", "raw"), "name", "name")
    _column("name_omitted", trip("name", "omitted"), "''", "name")
    _add("name_split", lambda s, d: reads(s, d).select("event_id", codecs.split_name(C("name")).alias("p")).select("event_id", "p.id", "p.description"), f"SELECT event_id, {ID} AS id, {DESCRIPTION} AS description FROM reads")
    _column("name_round_trip", lambda: codecs.codec("name", "split").round_trip(F.concat("name", F.when(C("event_id") % 7 == 0, " ").otherwise(""))), "CASE WHEN event_id % 7 = 0 AND instr(name, ' ') = 0 THEN name WHEN event_id % 7 = 0 THEN concat(name, ' ') ELSE name END", "name")
    # keys
    for k in (31, 5):
        _column(f"prefix_kmer_{k}", lambda k=k: keys.prefix_kmer(C("sequence"), k).cast("string"), f"CAST({_prefix(k)} AS VARCHAR)", "key")
    for k, w in ((31, 15), (5, 7)):
        _column(f"minimizer_{k}_{w}", lambda k=k, w=w: keys.minimizer(C("sequence"), k, w).cast("string"), f"CAST({_minimizer(k)} AS VARCHAR)", "key")
    kmers = f"list_transform(range(1, CAST(length(sequence) AS BIGINT) - 3), lambda j: {_canonical(f'substr({UPPER}, CAST(j AS INT), 5)')})"
    _add("window_minimizers_5_7", lambda s, d: reads(s, d).select("event_id", F.array_join(keys.window_minimizers(C("sequence"), 5, 7).cast("array<string>"), ",").alias("keys")), f"SELECT event_id, CASE WHEN usable THEN array_to_string(list_transform(list_sort(list_distinct(list_transform(range(1, len(kmers) - 5), lambda j: list_min(kmers[j : j + 6])))), lambda m: {_value('m', 5)}), ',') END AS keys FROM (SELECT event_id, regexp_matches(sequence, '^[ACGTacgt]{{11,}}$') AS usable, {kmers} AS kmers FROM reads) AS x")
    _column("prefix_kmer_le_bytes", lambda: F.hex(keys.little_endian(keys.prefix_kmer(C("sequence"), 31))), f"CASE WHEN {_prefix(31)} IS NOT NULL THEN list_aggregate(list_transform(range(0, 8), lambda i: printf('%02X', ({_prefix(31)} >> (8 * i)) & 255)), 'string_agg', '') END", "key")
    for n in (8, 16):
        _column(f"bytes{n}_prefix_key", lambda n=n: F.hex(keys.prefix_bytes(text.to_bytes(C("sequence")), n)), f"rpad(substr(hex(encode(sequence)), 1, {2 * n}), {2 * n}, '0')", "key")
    _column("bytes8_xor_key", lambda: F.hex(keys.xor_bytes(text.to_bytes(C("sequence")), 8)), "list_aggregate(list_transform(range(0, 8), lambda j: printf('%02X', list_reduce(list_prepend(0, list_transform(range(j + 1, CAST(length(sequence) AS BIGINT) + 1, 8), lambda i: ascii(substr(sequence, CAST(i AS INT), 1)))), lambda a, b: xor(a, b)))), 'string_agg', '')", "key")
    # presets
    for label, kind, sql in (("prefix_kmers", "prefix_kmer", _prefix(31)), ("minimizers", "minimizer", _minimizer(31))):
        for suffix, payload in (("", []), ("_with_sequences", ["sequence"]), ("_with_names", ["name"])):
            _add(label + suffix, lambda s, d, kind=kind, payload=payload: workflows.preset(reads(s, d), kind, *payload), f"SELECT {', '.join([*payload, 'key'])} FROM {_keyed(sql)} WHERE key IS NOT NULL")
    _add("kmer_name_pairs", lambda s, d: workflows.preset(reads(s, d), "minimizer", "name", k=5, w=7), f"SELECT name, key FROM {_keyed(_minimizer(5))} WHERE key IS NOT NULL")
    _add("key_only", lambda s, d: reads(s, d).select(F.hex(keys.prefix_bytes(text.to_bytes(C("sequence")))).alias("key")), "SELECT rpad(substr(hex(encode(sequence)), 1, 16), 16, '0') AS key FROM reads")
    # workflows
    _add("external_sort", lambda s, d: workflows.external_sort(workflows.with_key(reads(s, d), "prefix_kmer").select("key", "name", "sequence", "quality"), "key", "name"), f"SELECT key, name, sequence, quality FROM {keyed} WHERE key IS NOT NULL ORDER BY key, name")
    run = "event_id // 50"
    _add("sorted_runs", lambda s, d: workflows.sorted_runs(reads(s, d), 50, "event_id", "sequence", "event_id").select("run", C("place").cast("long").alias("place"), "event_id"), f"SELECT CAST({run} AS BIGINT) AS run, row_number() OVER (PARTITION BY {run} ORDER BY sequence, event_id) AS place, event_id FROM reads")
    _add("sort_check", lambda s, d: workflows.sort_report(workflows.external_sort(workflows.with_key(reads(s, d), "prefix_kmer", k=5).select("key", "name"), "key", "name"), "key"), f"SELECT count(*) AS n_rows, count(*) - count(DISTINCT key) AS ties, CAST(0 AS BIGINT) AS falls, min(key) AS first, max(key) AS last FROM {_keyed(_prefix(5))} WHERE key IS NOT NULL")
    _add("sort_check_of_unsorted", lambda s, d: workflows.sort_violations(reads(s, d).withColumn("run", F.floor(C("event_id") / 50)), "run", "event_id", "sequence"), f"SELECT CAST(sum(CASE WHEN before > sequence THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT sequence, lag(sequence) OVER (PARTITION BY {run} ORDER BY event_id) AS before FROM reads) AS x")
    _add("partition_first_base", lambda s, d: reads(s, d).select("event_id", workflows.first_base_bucket().cast("long").alias("bucket")), f"SELECT event_id, CAST({BUCKET} AS BIGINT) AS bucket FROM reads")
    _add("partition_prefix_kmer", lambda s, d: workflows.with_key(reads(s, d), "prefix_kmer").select("name", workflows.kmer_bucket().cast("long").alias("bucket")), f"SELECT name, CAST(key % 4 AS BIGINT) AS bucket FROM {keyed} WHERE key IS NOT NULL")
    _add("bucket_counts", lambda s, d: workflows.bucket_counts(reads(s, d), workflows.first_base_bucket().cast("long")), f"SELECT CAST({BUCKET} AS BIGINT) AS bucket, count(*) AS n_reads FROM reads GROUP BY 1")
    _add("block_layout", lambda s, d: workflows.block_layout(reads(s, d), "event_id", 512), "SELECT CAST(event_id // 512 AS BIGINT) AS block, count(*) AS n_records, min(event_id) AS first, max(event_id) AS last FROM reads GROUP BY 1")
    _add("compact_profile", lambda s, d: workflows.transcode(reads(s, d), {"sequence": "two_bit_exact", "quality": "binned", "name": "split"}), f"SELECT event_id, name, {EXACT} AS sequence, {BINNED} AS quality FROM reads")
    _add("lossy_profile", lambda s, d: workflows.transcode(reads(s, d), {"sequence": "two_bit_lossy_n", "quality": "binned", "name": "split"}), f"SELECT event_id, name, {LOSSY} AS sequence, {BINNED} AS quality FROM reads")
    compact = f"{WORDS} + 4 + 5 * {N_ODD} + length(quality) + 4 + length(name) - CASE WHEN instr(name, ' ') > 0 THEN 1 ELSE 0 END"
    _add("compaction_ratio", lambda s, d: workflows.size_report(reads(s, d), workflows.COMPACT, workflows.RAW), f"SELECT count(*) AS n_reads, CAST(sum({compact}) AS BIGINT) AS bytes, CAST(sum(length(name) + length(sequence) + length(quality)) AS BIGINT) AS bytes_against FROM reads")
    plain = "SELECT name, sequence, quality FROM reads"
    _add("spill_reload", _spill_reload, plain)
    for n in (8, 16):
        _add(f"dataset_keys_{n}", lambda s, d, n=n: _key_dataset(s, d, n), f"SELECT rpad(substr(hex(encode(sequence)), 1, {2 * n}), {2 * n}, '0') AS key FROM reads")
    _add("transcode_compact", _transcoded, f"SELECT name, {EXACT} AS sequence, {BINNED} AS quality FROM reads")
    _add("to_fastq", lambda s, d: to_fastq(reads(s, d)), "SELECT concat('@', name, chr(10), sequence, chr(10), '+', chr(10), quality) AS value FROM reads")
    _add("fastq_round_trip", _fastq_round_trip, plain)
    _add("record_round_trip", lambda s, d: text.text_reads(from_records(to_records(_binary(reads(s, d))), "record")), plain)
    base = "CASE WHEN (31 * i + 17 * j) % 100 = 0 THEN 'N' ELSE substr('ACGT', CAST((7 * i + 13 * j) % 4 + 1 AS INT), 1) END"
    _add("generate_reads", lambda s, d: generated(s, 10_000), f"SELECT i, concat('INSTRUMENT:RUN:FLOWCELL:1:1101:', 1000 + i // 100, ':', 2000 + i % 100, ' 1:N:0:ATCACG') AS name, list_aggregate(list_transform(range(0, 150), lambda j: {base}), 'string_agg', '') AS sequence, list_aggregate(list_transform(range(0, 150), lambda j: chr(CAST((3 * i + 11 * j) % 35 + 38 AS INT))), 'string_agg', '') AS quality FROM (SELECT unnest(range(0, 10000)) AS i) AS x")


def _binary(frame: DataFrame) -> DataFrame:
    return frame.select(*(text.to_bytes(C(c)).alias(c) for c in ("name", "sequence", "quality")))


def _spill_reload(s: SparkSession, d: str) -> DataFrame:
    """Keyed reads written to a scratch folder with raw codecs and read again. The folder stays as long as the result may be read: with the session's files."""
    scratch = TempDataset(s)
    keyed = _binary(reads(s, d)).withColumn("key", keys.prefix_bytes(C("sequence")))
    writer().bytes8_key().save(keyed, scratch.path)
    _SCRATCH.append(scratch)
    return text.text_reads(reader(s).bytes8_key().select("name", "sequence", "quality").load(scratch.path))


def _key_dataset(s: SparkSession, d: str, width: int) -> DataFrame:
    """Keys without any payload written to a scratch folder and scanned alone."""
    scratch = TempDataset(s)
    keyed = _binary(reads(s, d)).withColumn("key", keys.prefix_bytes(C("sequence"), width))
    writer().empty_payload().record_key(f"bytes{width}").save(keyed, scratch.path)
    _SCRATCH.append(scratch)
    return reader(s).empty_payload().record_key(f"bytes{width}").select("key").load(scratch.path).select(F.hex("key").alias("key"))


def _transcoded(s: SparkSession, d: str) -> DataFrame:
    """Raw reads piped into the compact profile and read again."""
    first, second = TempDataset(s), TempDataset(s)
    writer().save(_binary(reads(s, d)), first.path)
    compact = lambda x: x.two_bit_exact().quality_codec("binned").name_codec("split")
    compact(writer()).save(reader(s).load(first.path), second.path)
    first.cleanup()
    _SCRATCH.append(second)
    return text.text_reads(compact(reader(s)).load(second.path))


def _fastq_round_trip(s: SparkSession, d: str) -> DataFrame:
    scratch = TempDataset(s)
    write_fastq(reads(s, d), scratch.path)
    _SCRATCH.append(scratch)
    return read_fastq(s, scratch.path)


#: Scratch folders of results that are still to be read; they go when the interpreter or the JVM ends.
_SCRATCH: list[TempDataset] = []
_register()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
