"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams, a window of a text, one at every word, is the mean of its words, and a softmax
over two classes reads the window's mean; a text scores as its most toxic window, so its length does not dilute it. Spellings
that training never saw share n-gram vectors with those it did.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import blocks, rows, slices, utf8

#: Labelled rows of each class that training may take; a bound on what one task holds.
SAMPLE = 3000
BUCKETS, SIZE, WINDOW, GRAMS = 1 << 17, 4, 2, (3, 4, 5, 6)
EPOCHS, STEPS, BATCH, RATE, SEED = 15, 300, 256, 0.04, 7  # at least so many epochs and steps
THRESHOLD = 0.3
#: How much more the most toxic window counts at the end of training: by exp of this times the difference of scores.
SHARPEST = 4.0
#: Words whose scores one worker keeps.
KEPT_WORDS = 300_000


def subwords(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, bucket) of all n-grams of marked words, a pair of arrays for each n. Any marked word but the empty one has one."""
    marked = [f"<{w}>" for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)[word]
    for n in GRAMS:
        if len(chars) < n:
            continue
        h = np.full(len(chars) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + chars[i : len(chars) - n + 1 + i]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = np.arange(len(h)) + n <= ends[: len(h)]
        yield word[: len(h)][inside], (h[inside] >> np.uint64(47)).astype(np.int64)


def _bags(words: list[str], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words in order, ends) of the n-grams of words; each word has at least one n-gram."""
    buckets, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), step):
        some = words[i : i + step]
        parts = [*subwords(some), (np.arange(len(some)), np.zeros(len(some), np.int64))]  # the first bucket stands for any word
        word, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        buckets.append(bucket[np.argsort(word, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(word, minlength=len(some)))
    return np.concatenate(buckets), np.cumsum(np.concatenate(sizes))


def bag(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, distinct windows as places of words, how often each window is there) of a whole text; a window at every word, -1 beyond a shorter text."""
    place: dict[str, int] = {}
    words = np.array([place.setdefault(w, len(place)) for w in text.lower().split() or [""]], np.int32)
    size = min(WINDOW, len(words))
    windows = np.full((len(words) - size + 1, WINDOW), -1, np.int32)
    windows[:, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
    return list(place), *np.unique(windows, axis=0, return_counts=True)


def train(texts: Iterable[tuple[float, list[str], np.ndarray, np.ndarray]], stands: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias): embeddings times the softmax's weights, as only their product is needed to score.

    texts: each a label, 0 or 1, and what ``bag`` gives. stands: how many labelled rows each clean and each toxic text stands
    for. Rows weigh by it, so a sample with a bound on each class has the class ratio of all rows.

    With one class, or none, the scores are zero and the bias gives the class (no rows: not toxic).
    """
    rng = np.random.default_rng(SEED)
    place: dict[str, int] = {}
    docs, known = [], []
    for label, own, windows, times in texts:
        ids = np.array([place.setdefault(w, len(place)) for w in own], np.int32)
        docs.append((np.where(windows < 0, np.int32(-1), ids[windows]), times))
        known.append(label)
    labels = np.array(known, np.float64)
    if len(set(known)) < 2:
        return np.zeros(BUCKETS, np.float32), 4.0 if labels.any() else -4.0
    grams, gram_ends = _bags(list(place))
    gram_starts = np.append(0, gram_ends[:-1])
    emb, weights = rng.normal(0, 0.1, (BUCKETS, SIZE)).T.astype(np.float32), rng.normal(0, 1, (SIZE, 2)).astype(np.float32)
    bias = np.array([2.0, -2.0])  # toxic texts are rare, and one without words isn't
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, weights)]
    weight = np.where(labels > 0, stands[1], stands[0])
    weight = weight / weight.mean()
    step = 0
    parts = -(-len(docs) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // parts))
    steps = epochs * parts
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(docs)), parts):
            step += 1
            # the mean vectors of the batch's words, and what each adds to the difference of the two classes
            tokens = np.concatenate([docs[i][0] for i in batch])
            there = tokens >= 0
            used = np.zeros(len(place) + 1, bool)
            used[tokens] = True  # the last stands for no word
            words = np.flatnonzero(used[:-1])
            of = np.zeros(len(place) + 1, np.int32)
            of[words] = np.arange(len(words))
            counts = gram_ends[words] - gram_starts[words]
            word_ends = np.cumsum(counts)
            buckets = grams.take(np.arange(word_ends[-1]) - np.repeat(word_ends - counts - gram_starts[words], counts)).astype(np.intp)
            vectors = np.stack([np.add.reduceat(e.take(buckets), word_ends - counts) for e in emb]) / counts
            lean = weights[:, 1] - weights[:, 0]
            each = (lean @ vectors)[of[tokens]] * there
            length = there.sum(axis=1)
            margin = each.sum(axis=1) / length + bias[1] - bias[0]
            # at first all windows stand for their text alike, in the end the most toxic ones
            win = np.array([len(docs[i][0]) for i in batch])
            doc, first = np.repeat(np.arange(len(batch)), win), np.cumsum(win) - win
            times = np.concatenate([docs[i][1] for i in batch])
            pull = times * np.exp(SHARPEST * step / steps * (margin - np.maximum.reduceat(margin, first)[doc]))
            pull /= np.add.reduceat(pull, first)[doc]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(pull * margin, first), -30, 30)))
            d = ((p - labels[batch]) * weight[batch] / len(batch))[doc] * pull / length
            d_word = np.bincount(of[tokens[there]], np.repeat(d, length), len(words))
            grad_w = np.outer(vectors @ d_word, [-1.0, 1.0]).astype(np.float32)
            grad_e = np.outer(lean, np.bincount(buckets, np.repeat(d_word / counts, counts), BUCKETS).astype(np.float32))
            for x, g, (m, v) in zip((emb, weights), (grad_e, grad_w), moments, strict=True):
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                x -= np.float32(RATE / (1 - 0.9**step)) * m / (np.sqrt(v / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return ((weights[:, 1] - weights[:, 0]) @ emb).astype(np.float32), float(bias[1] - bias[0])


class WordScores(dict):
    """The scores of words under a model; bounded: it starts afresh when full."""

    def __init__(self, model: np.ndarray):
        self.model = model

    def of(self, texts: list[list[str]]) -> None:
        """Make the scores of all words of texts known."""
        new = list({w for words in texts for w in words if w not in self})
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = list({w for words in texts for w in words})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            sums, counts = np.full(len(part), float(self.model[0])), np.ones(len(part))
            for word, bucket in subwords(part):
                sums += np.bincount(word, self.model[bucket], len(part))
                counts += np.bincount(word, minlength=len(part))
            self.update(zip(part, (sums / counts).tolist(), strict=True))


def score_text(words: list[str], scores: dict[str, float], bias: float) -> float:
    """The probability that the most toxic window is toxic; a text without words is one window with a mean of zero."""
    top = 0.0
    if words:
        each = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
        size = min(WINDOW, len(each))
        top = (sum(each[k : len(each) - size + 1 + k] for k in range(size)) / size).max()
    return float(1 / (1 + np.exp(-np.clip(top + bias, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from the labelled texts of docs: at most sample rows of each class, those of the least hash of doc_id.

    labels: (doc_id, toxic). Null labels and doc_ids are left out; of repeated labels the greatest counts, of repeated texts
    the least. The sample is the documented bound on what one task trains on, and its rows weigh by the count of their class
    among all labels, so that scores mean the same at every size; the model has a fixed size.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    total = {k["toxic"]: k["n"] for k in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands = tuple(max(1.0, total.get(kind, 0) / sample) for kind in (0, 1))
    first = lambda kind: known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = first(0).unionByName(first(1))
    texts = docs.select("doc_id", utf8().alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, toxic, text in rows(batches, 16):
            words, windows, times = bag(text.decode("utf-8", "replace"))
            row = (doc_id, toxic, "\n".join(words), windows.astype("<i4").tobytes(), times.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "toxic", "words", "windows", "times"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, bias = train(((float(k), w.split("\n"), np.frombuffer(p, "<i4").reshape(-1, WINDOW), np.frombuffer(n, "<i4")) for _, k, w, p, n in rows(batches, 16)), stands)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()]), pa.array([bias])], ["model", "bias"])

    whole = texts.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(reduce, "doc_id long, toxic int, words string, windows binary, times binary")
    one = whole.repartition(1).sortWithinPartitions("doc_id")  # no more than sample rows of each class
    found = one.mapInArrow(fit, "model binary, bias double").first()
    return (np.frombuffer(found["model"], np.float32), found["bias"]) if found else (np.zeros(BUCKETS, np.float32), -4.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) of every row of docs, by whole texts. Null texts are empty; repeated rows are scored each for itself; other columns are dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        scores = WordScores(table)
        for _, ids, texts in blocks(batches, 2 << 20):
            words = [t.decode("utf-8", "replace").lower().split() for t in texts]
            scores.of(words)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([score_text(w, scores, bias) for w in words], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), utf8()).mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, by a model learnt from the rows that are not held out.

    held_out: crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id. See ``learn`` and ``score``.
    """
    model = learn(docs, labels.where(~held_out()), sample)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns: ``classify`` and a filter in the same pass, each row for itself."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.where(~held_out()), sample))  # BUCKETS numbers
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        scores = WordScores(table)
        for part, texts in slices(batches, at):
            words = [t.decode("utf-8", "replace").lower().split() for t in texts]
            scores.of(words)
            yield part.filter(pa.array([score_text(w, scores, bias) < threshold for w in words]))

    return docs.mapInArrow(run, docs.schema)
