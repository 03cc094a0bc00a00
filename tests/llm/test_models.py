"""Language model, quality rules, license scans and toxicity."""

import collections
import math
import os
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest

from readloom.llm import language_model, licenses, quality, queries, toxicity

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def test_model_of_a_block_takes_few_bytes_a_token():
    rnd = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.3, 300) % 50_000).encode() for _ in range(1000)]
    tracemalloc.start()
    try:
        grams = language_model.Grams(texts, 3)
        counts = grams.counts(np.ones(len(texts), bool)).astype(np.int64)
        order = (grams.keys & np.uint64(7)).astype(int)
        sums = [(int(counts[order == k].sum()), int((order == k).sum()), int((counts[order == k] == 1).sum())) for k in range(3)]
        language_model.Automaton(grams, counts, sums).scores(grams.sizes)
        assert tracemalloc.get_traced_memory()[1] < 170 * len(grams.words)
    finally:
        tracemalloc.stop()


def brute_model(rows, order):
    """Scores by the recursive definition of the interpolated model."""
    texts, counts = [], collections.Counter()
    for key, text in rows:
        words = [*(text or "").encode().lower().split(), b"\n"]
        texts.append(words)
        if key is None or zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(tuple(words[i - n : i + 1]) for n in range(order) for i in range(n, len(words)))
    tokens = [sum(v for g, v in counts.items() if len(g) == n + 1) for n in range(order)]
    once = [sum(v == 1 for g, v in counts.items() if len(g) == n + 1) for n in range(order)]
    kinds = sum(len(g) == 1 for g in counts)
    share = [min(0.999, max(0.001, a / b)) if b else 1.0 for a, b in zip(once, tokens)]

    def p(context, word):
        if not context:
            return (1 - share[0]) * counts[(word,)] / max(tokens[0], 1) + share[0] / (kinds + 1)
        if not counts[context]:
            return p(context[1:], word)
        return (1 - share[len(context)]) * counts[(*context, word)] / counts[context] + share[len(context)] * p(context[1:], word)

    for (key, _), words in zip(rows, texts):
        base = sum(math.log10((counts[(w,)] + 1) / (tokens[0] + kinds + 1)) for w in words)
        yield key, len(words), sum(counts[(w,)] > 0 for w in words), tokens[0], base, sum(math.log10(p(tuple(words[max(0, i - order + 1) : i]), w)) for i, w in enumerate(words))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(spark, sample, odd, order, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK", 50_000)
    for frame in (sample[0], odd):
        rows = [(r.doc_id, r.text) for r in frame.collect()]
        got = in_order((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in language_model.score(frame, order).collect())
        want = in_order(brute_model(rows, order))
        assert [g[:4] for g in got] == [w[:4] for w in want]
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_language_model_of_nothing(odd):
    assert language_model.score(odd.limit(0)).collect() == []
    held = odd.where("doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert {(r.score, r.base_score, r.n_known) for r in language_model.score(held).collect()} <= {(0.0, 0.0, 0)}
    with pytest.raises(ValueError):
        language_model.score(odd, 9)


@pytest.mark.parametrize("name", ["op2_host_quality", "op8_licenses"])
@pytest.mark.parametrize("which", ["sample", "odd"])
def test_against_sql(spark, odd, name, which, tmp_path):
    folder = SF
    if which == "odd":
        folder = str(tmp_path)
        # SQL tells rows apart by their ids
        odd.select("text", "source").toPandas().rename_axis("doc_id").reset_index().to_parquet(f"{folder}/documents.parquet")
    elif not os.path.isdir(SF):
        pytest.skip("no test data")
    got = queries.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(want.select(*names).fetchall(), key=key)


def test_repeated_words(spark):
    def brute(words):
        windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        return len({j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})

    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 1, 2, 3, 4, 5, 8, 20, 60)] + ["a a a a", "a b c a b c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.measure(frame).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t.split()) for t in texts]


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [("bad", "short")] * 40 + [("bad", good)] * 2 + [("tiny", "short")] + [("tiny", good)] + [(f"h{i % 9}", good) for i in range(500)]
    frame = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.verdicts(frame).collect()}
    assert all(got[i].host_failed for i in range(42)) and not got[42].host_failed
    assert got[43].kept and not got[42].kept and all(got[i].kept for i in range(44, len(rows)))
    assert quality.keep_good(frame).count() == 501
    assert quality.keep_good(frame).columns == frame.columns
    assert quality.keep_good(frame.limit(0)).collect() == []
    assert {r.host_failed for r in quality.verdicts(frame.where("source <> 'bad'")).collect()} == {False}
    assert quality.verdicts(frame.limit(0)).collect() == []


def test_quality_of_odd_rows(odd):
    """Null and repeated ids, nulls in all columns, and columns named as the measures are."""
    got = quality.verdicts(odd).collect()
    want = {str(r.doc_id) for r in odd.collect()}
    assert len(got) == len(ODD) and {str(r.doc_id) for r in got} == want
    assert quality.measure(odd).columns.count("n_words") == 1
    loose = quality.keep_good(odd, min_words=0)
    assert loose.columns == odd.columns and loose.schema == odd.schema
    rows = {tuple(r) for r in odd.collect()}
    assert {tuple(r) for r in loose.collect()} <= rows
    assert quality.keep_good(odd).count() == sum(r.kept for r in got)


def test_beta_prior():
    assert quality.beta_prior(0, 0, 0.0, 0, 0.0) == (0.0, 10.0)
    alpha, total = quality.beta_prior(3, 300, 30000.0, 30, 3.0)  # no spread at all
    assert total == 1e6 and abs(alpha / total - 0.1) < 1e-12


def test_licenses_of_nothing_and_placing(spark, odd):
    assert licenses.scan(odd.limit(0)).collect() == []
    rows = [(0, "CC-BY cc by cc by"), (1, "x\nGeneral public LICENSE."), (2, "Licensed under the Apache License, Version 2.0."), (3, "Licensed under the Apache License"), (4, "ccc by; all rights\nreserved é")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (6, 3, 0, 4, "cc-by")
    assert (got[1].first_word, got[1].base_labels, got[1].score) == (1, "gpl", 1.0)
    assert (got[2].base_labels, got[2].labels, got[2].first_word, got[2].score) == ("", "apache-2.0", None, 1.0)
    assert (got[3].labels, got[3].score) == ("", 0.0)
    assert (got[4].base_labels, got[4].first_word, got[4].n_words) == ("reserved", 2, 6)
    many = licenses.scan(odd, templates=(("x", " ".join(map(str, range(30_000)))),)).collect()  # no cap on templates
    assert len(many) == len(ODD) and {r.labels for r in many} == {""}
    assert {r.labels for r in licenses.scan(odd, templates=()).collect()} == {""}
    assert sorted(str(r.doc_id) for r in licenses.scan(odd).collect()) == sorted(str(r.doc_id) for r in odd.collect())


def test_licenses_are_told_apart(spark):
    """Every notice gives exactly its own label beside those of phrases, also when its lines are wrapped and prose is around it."""
    rng = np.random.default_rng(5)
    prose = lambda n: " ".join("".join(rng.choice(list("etaonrish"), 5)) for _ in range(n))
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "Released under the MIT License.": "mit",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa-4.0",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "All rights reserved.": "reserved",
        "Released under the GPL license": "",
        "This Source Code Form is subject to the terms of the Mozilla\nPublic\nLicense, v. 2.0": "mpl-2.0",
    }
    for label, text in licenses.TEMPLATES:
        wrapped = text.replace(", ", ",\n * ")
        base = [v for k, v in licenses.PHRASES.items() if f" {k} " in f" {' '.join(licenses.re.split(licenses.BETWEEN_WORDS, text.lower()))} "]
        notices[wrapped] = ",".join(sorted({label, *base}))
    rows = [(text, want) for notice, want in notices.items() for text in (notice, f"{prose(37)}\n{notice}\n{prose(300)}")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    wrong = [(rows[i], got[i]) for i in range(len(rows)) if got[i] != rows[i][1]]
    assert not wrong


def toxic_rows(n, start, words, rng):
    letters = np.random.default_rng(8)  # the same common words each time
    plain = ["".join(letters.choice(list("etaonrish"), letters.integers(2, 9))) for _ in range(800)]
    for i in range(start, start + n):
        text = list(rng.choice(plain, 40))
        if i % 4 == 0:
            text.insert(int(rng.integers(40)), str(rng.choice(words)))
        yield i, " ".join(text), int(i % 4 == 0)


def test_toxicity_of_unseen_spellings(spark):
    rng = np.random.default_rng(3)
    known = list(toxic_rows(800, 0, ["blagghoker", "blagghokers", "vumpazoid", "vumpazoids"], rng))
    unseen = list(toxic_rows(400, 1000, ["blagghokerz", "xblagghoker", "vumpazoidal", "vvumpazoid"], rng))
    docs = spark.createDataFrame([r[:2] for r in known + unseen], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in known], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 1200 and all(r.predicted == (r.score >= 0.3) for r in got.values())
    right = [got[i].predicted == y for i, _, y in unseen]
    assert sum(right) / len(right) > 0.95
    held = [got[i].predicted == y for i, _, y in known if got[i].held_out]
    assert held and sum(held) / len(held) > 0.95
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}


def test_toxicity_scores_depend_on_texts_and_training_labels_alone(spark):
    """Neither labels of held-out rows nor lang, source or other ids change a score."""
    rng = np.random.default_rng(4)
    rows = list(toxic_rows(300, 0, ["blagghoker", "vumpazoid"], rng))
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    docs = spark.createDataFrame([(i, t, "en", "src1") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    other = spark.createDataFrame([(i, t, f"l{i}", f"s{i * y}") for i, t, y in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, 1 - y if h else y) for (i, _, y), h in zip(rows, held)], "doc_id long, toxic int")
    assert any(held)
    scores = [{r.doc_id: r.score for r in toxicity.classify(d, y).collect()} for d, y in ((docs, labels), (other, labels), (docs, turned))]
    assert scores[0] == scores[1] == scores[2]


def test_toxicity_keeps_the_class_ratio_of_all_labels(spark):
    docs = spark.createDataFrame([(i, "maybe so") for i in range(1200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1200)], "doc_id long, toxic int")
    whole, few = (toxicity.classify(docs.limit(1200), labels, n).agg({"score": "avg"}).first()[0] for n in (3000, 50))
    assert abs(whole - 0.1) < 0.05 and abs(few - 0.1) < 0.05


def test_toxicity_scores_every_pair():
    scores = {"bad": 3.0, "word": 3.0, "so": -3.0, "": 0.0}
    for text in ("bad word so so", "so bad word so", "so so so bad word", "bad word"):
        assert abs(toxicity.score_text(text.split(), scores, 0.0) - 1 / (1 + np.exp(-3))) < 1e-9
    assert abs(toxicity.score_text(["so"], scores, 0.0) - 1 / (1 + np.exp(3))) < 1e-9


def test_toxicity_learns_from_whole_texts(spark):
    plain = "so maybe then " * 6000  # more than 64 KB
    rows = [(i, plain + ("blagghoker blagghoker" if i % 2 else "")) for i in range(24)] + [(100, "blagghoker blagghoker"), (101, "so maybe then")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.classify(docs, spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")).collect()}
    assert got[100] > 0.9 and got[101] < 0.3


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.classify(odd, labels.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.predicted for r in none)
    assert toxicity.classify(odd.limit(0), labels).collect() == []
    assert toxicity.keep_civil(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.keep_civil(odd, labels.limit(0)).columns == odd.columns
    assert toxicity.keep_civil(odd.limit(0), labels).collect() == []
