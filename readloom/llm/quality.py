"""Quality rules with verdicts on hosts, in DataFrame functions only.

Each document is measured once. Failures of every rule are added up by host, a host's rate is shrunk towards the rate of all
hosts by a beta prior fitted to them, and hosts whose shrunk rate of a rule is surely over its limit are rejected with all their
documents. The limit of a rule follows from the corpus: a multiple of the rate over all documents, and never under a floor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import cut, sized

#: The characters that part words, and those counted as symbols.
SPACE = " \t\n\x0b\x0c\r"
BETWEEN_WORDS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50
#: A host is rejected where its shrunk rate of failures, less its standard deviation, is over so many times the rate of all
#: documents, and over the floor.
EXCESS, FLOOR = 1.75, 0.05

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def rules(min_words: int = MIN_WORDS) -> dict[str, Column]:
    """Whether a measured document fails each rule; all are comparisons of whole numbers."""
    c = F.col
    return {
        "short": c("n_words") < min_words,
        "repetitive": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 5 * c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 5 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns MEASURES, all long, for a text column; a null text has no words. Columns of these names are replaced.

    Words that stand in three-word windows found twice or more are counted in n_repeat_words: windows are first compared by
    64-bit hash, and only where hashes repeat are the windows themselves sorted, so the count is exact.
    """
    own = [c for c in docs.columns if c not in MEASURES]
    clean = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    three = lambda join: F.slice(F.transform("__words", lambda w, i: join(w, F.get("__words", i + 1), F.get("__words", i + 2))), 1, F.greatest(F.size("__words") - 2, F.lit(0)))
    near = lambda j: F.coalesce(F.get("__sorted", j)["w"], F.lit(""))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    step = docs.withColumn("__clean", clean)
    step = step.withColumns({"__words": F.when(F.col("__clean") == "", F.array().cast("array<string>")).otherwise(F.split("__clean", BETWEEN_WORDS)), "__lines": lines})
    step = step.withColumn("__hashes", three(F.xxhash64))
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    step = step.withColumn("__windows", F.when(repeats, three(lambda *w: F.concat_ws(" ", *w))))
    step = step.withColumn("__sorted", F.sort_array(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    step = step.withColumn("__places", F.sort_array(F.transform(F.filter("__sorted", lambda x, j: (x["w"] == near(j - 1)) | (x["w"] == near(j + 1))), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("__places", start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n")), lambda a: a["n"])
    return step.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.translate("__clean", SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("__clean") - F.char_length(F.translate("__clean", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )


def host_rates(measured: DataFrame, host: str = "host", min_words: int = MIN_WORDS, excess: float = EXCESS, floor: float = FLOOR) -> DataFrame:
    """(host, n, f_<rule>, rate_<rule>, host_failed): a host's documents, its failures of each rule, their shrunk rates, and whether one of these, less the standard deviation of the host's own beta distribution, is over its limit.

    The prior of a rule is a beta distribution whose mean is the rate over all documents and whose strength comes from the
    spread of hosts about it, by the method of moments. Where hosts spread no more than chance does, the strength is at its
    upper limit, so each is near the mean and none fails. A null host is a host of its own.
    """
    names = list(rules(min_words))
    hosts = cut(measured.groupBy(host).agg(F.count("*").alias("n"), *(F.sum(v.cast("long")).alias(f"f_{k}") for k, v in rules(min_words).items())))
    n = F.col("n")
    sums = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(n.cast("double") * n).alias("nn"), *(F.sum(f"f_{k}").alias(f"f_{k}") for k in names), *(F.sum(F.col(f"f_{k}").cast("double") * F.col(f"f_{k}") / n).alias(f"ff_{k}") for k in names)).first()
    rates, over = [], []
    for k in names:
        alpha, total = beta_prior(sums["hosts"], sums["n"] or 0, sums["nn"] or 0.0, sums[f"f_{k}"] or 0, sums[f"ff_{k}"] or 0.0)
        rates.append(((F.col(f"f_{k}") + alpha) / (n + total)).alias(f"rate_{k}"))
        rate = F.col(f"rate_{k}")
        over.append(rate - F.sqrt(rate * (1 - rate) / (n + total + 1)) > max(floor, excess * (sums[f"f_{k}"] or 0) / (sums["n"] or 1)))
    return hosts.select(host, "n", *(f"f_{k}" for k in names), *rates).withColumn("host_failed", F.array_contains(F.array(*over), True))


def beta_prior(hosts: int, n: float, nn: float, f: float, ff: float, low: float = 10.0, high: float = 1e6) -> tuple[float, float]:
    """(alpha, alpha + beta) from the number of hosts and the sums of n, n*n, failures and failures*failures/n over them."""
    if not n:
        return 0.0, low
    mean = f / n
    noise = mean * (1 - mean)
    spread, room = ff - n * mean * mean - (hosts - 1) * noise, n - nn / n
    strength = high if spread <= 0 or room <= 0 else min(high, max(low, noise * room / spread - 1))
    return mean * strength, strength


def _failed_hosts(measured: DataFrame, min_words: int, excess: float, floor: float) -> DataFrame:
    """(bad_host, bad) of the hosts that are rejected; broadcast only where they are few."""
    rates = host_rates(measured, "host", min_words, excess, floor)
    return sized(rates.where("host_failed").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad")))


def _base_failed(min_words: int) -> Column:
    found = rules(min_words)
    return found["short"] | found["repetitive"]


def verdicts(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_words: int = MIN_WORDS, excess: float = EXCESS, floor: float = FLOOR) -> DataFrame:
    """One row per row of docs: the key, MEASURES, base_failed, host_failed, kept.

    base_failed: too short or too repetitive. host_failed: see ``host_rates``. kept: neither. Null texts are empty and fail,
    documents without a host share one, null and repeated keys are judged each for itself, and other columns are dropped. A hot
    host is one row of counts.
    """
    measured = cut(measure(docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))).drop("text"))
    judged = measured.join(_failed_hosts(measured, min_words, excess, floor), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    base, failed = _base_failed(min_words), F.coalesce("bad", F.lit(False))
    return judged.select(F.col("key").alias(key), *MEASURES, base.alias("base_failed"), failed.alias("host_failed"), (~base & ~failed).alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", min_words: int = MIN_WORDS, excess: float = EXCESS, floor: float = FLOOR) -> DataFrame:
    """The rows of docs that ``verdicts`` keeps, with all their columns, each row judged for itself.

    Rows that pass the rules are written once with what was measured, and wait there for the verdicts on hosts; texts are not
    shuffled unless failed hosts are too many to be broadcast.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.col(host).alias("host"), F.col(text).alias("text"))
    base = _base_failed(min_words)
    measured = cut(measure(packed).drop("text").withColumn("doc", F.when(~base, F.col("doc"))))
    bad = _failed_hosts(measured, min_words, excess, floor)
    good = measured.where(~base).join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left_anti")
    return good.select("doc.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) AS x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) AS x WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) AS x GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
r AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive FROM m),
f AS (SELECT source, k, count(*)::DOUBLE AS n, sum(CASE WHEN v THEN 1 ELSE 0 END)::DOUBLE AS f
      FROM (SELECT source, unnest(['short', 'repetitive', 'symbols', 'dup_lines', 'word_length']) AS k,
                   unnest([short, repetitive, 10 * n_symbols > 5 * n_words, 10 * n_dup_lines > 5 * n_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words]) AS v FROM r) AS x
      GROUP BY source, k),
s AS (SELECT k, count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, sum(f) / sum(n) AS mean, sum(f * f / n) AS ff FROM f GROUP BY k),
t AS (SELECT k, mean, mean * (1 - mean) AS noise, ff - n * mean * mean - (hosts - 1) * mean * (1 - mean) AS spread, n - nn / n AS room FROM s),
p AS (SELECT k, mean, CASE WHEN spread <= 0 OR room <= 0 THEN 1e6 ELSE least(1e6, greatest(10.0, noise * room / spread - 1)) END AS strength FROM t),
e AS (SELECT source, (f.f + mean * strength) / (f.n + strength) AS rate, f.n + strength AS weight, mean FROM f JOIN p ON f.k = p.k),
h AS (SELECT source, bool_or(rate - sqrt(rate * (1 - rate) / (weight + 1)) > greatest(0.05, 1.75 * mean)) AS bad FROM e GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed, bad AS host_failed,
       NOT (short OR repetitive) AND NOT bad AS kept
FROM r JOIN h ON r.source IS NOT DISTINCT FROM h.source
"""


#: The same with the language of a document in place of its host.
LANGUAGE_ORACLE = ORACLE.replace("SELECT doc_id, source, coalesce(text, '')", "SELECT doc_id, lang AS source, coalesce(text, '')")


def host_quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """The query's columns of ``verdicts``."""
    return verdicts(docs, host=host).drop("n_lines")
