"""Language-model scores by a weighted backoff automaton.

n-grams are counted over all training texts by an exchange: every block of documents sends the distinct n-grams it holds, with
its training counts, to buckets of the hash space, and gets their corpus counts back. With these each block builds the part of
the automaton that its own texts can reach: a state for each seen context, an arc for each seen continuation, and a failure arc
to the next shorter context. One traversal from left to right carries the state and adds up log probabilities.

Smoothing is interpolated: p(w|h) = (1-g) c(hw)/c(h) + g p(w|h'), where g, for each order, is the share of n-gram tokens that
occur once in the corpus; below the words lies a uniform distribution over the vocabulary and one unknown word.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import block_rows, block_texts, blocks, bucket_count, cut, rows_digest, utf8
from readloom.llm.exchange import REQUESTS, answer, framed, meet, pack_sorted, request_batch, squeeze, tabled, to_bucket, totals, unframed, unpack_sorted, unsqueeze

ORDER, MAX_ORDER = 3, 8
#: Bytes of text in a block: it bounds the automaton that one task holds.
BLOCK = 6 << 20
#: Tokens that a traversal takes at once.
SPAN = 256
#: The token that ends every text; no word contains white space.
END = b"\n"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Grams:
    """The n-grams of a block: keys (rising, distinct, of all orders), and for each order the gram that ends at each token, or -1.

    A key is a 64-bit hash whose lowest three bits are the order less one.
    """

    def __init__(self, texts: list[bytes], order: int):
        from xxhash import xxh64_intdigest

        place = {END: 0}
        ids: list[int] = []
        sizes = []
        for text in texts:
            words = text.lower().split()
            words.append(END)
            ids += [place.setdefault(w, len(place)) for w in words]
            sizes.append(len(words))
        # places in a block fit 32 bits; one order is sorted at a time, as these arrays are most of what a task holds
        self.sizes, self.words = np.array(sizes, np.int64), np.array(ids, np.int32)
        del ids
        own = np.array([xxh64_intdigest(w) for w in place], np.uint64)
        single, which = np.unique(_mix(own) & ~np.uint64(7), return_inverse=True)
        hashes = own[self.words]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), self.sizes)
        kinds, valid, inverse, gram = [single], [], [], _mix(hashes)
        for k in range(1, order):
            ok = np.arange(len(doc)) >= k
            ok[k:] &= doc[k:] == doc[: len(doc) - k]
            gram = _mix(np.append(np.zeros(1, np.uint64), gram[:-1]) * np.uint64(0x9E3779B97F4A7C15) + hashes)
            some, nth = np.unique((gram & ~np.uint64(7) | np.uint64(k))[ok], return_inverse=True)
            kinds.append(some)
            valid.append(ok)
            inverse.append(nth.astype(np.int32))
        del hashes, doc, gram
        both = np.concatenate(kinds)
        rising = np.argsort(both, kind="stable")
        place_of = np.empty(len(both), np.int32)
        place_of[rising] = np.arange(len(both), dtype=np.int32)
        self.keys, self.at, start = both[rising], [place_of[which[self.words]]], len(single)
        for some, ok, nth in zip(kinds[1:], valid, inverse, strict=True):
            at = np.full(len(ok), -1, np.int32)
            at[ok] = place_of[start + nth]
            start += len(some)
            self.at.append(at)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """Tokens of each gram in the chosen documents."""
        mask = np.repeat(chosen, self.sizes)
        return sum(np.bincount(at[mask & (at >= 0)], minlength=len(self.keys)) for at in self.at)


class Automaton:
    """The reachable part of the model: an arc for each gram that training has, and failure arcs. State 0 has the empty context, state i + 1 that of gram i."""

    def __init__(self, grams: Grams, counts: np.ndarray, sums: list[tuple[int, int, int]]):
        """counts: of the grams, over the corpus. sums: for each order the tokens, the distinct grams and the grams seen once."""
        order, words = len(grams.at), grams.words
        n, kinds, _ = sums[0]
        shares = [min(0.999, max(0.001, once / tokens)) if tokens else 1.0 for tokens, _, once in sums]
        uniform = 1 / (kinds + 1)
        p, self.nexts = np.zeros(len(counts)), np.zeros(len(counts), np.int32)  # nexts: the state reached by an arc
        self.fails, self.weights = np.full(len(counts) + 1, -1, np.int32), np.full(len(counts) + 1, math.log10(shares[0] * uniform))
        self.length = np.zeros(len(counts) + 1, np.int8)  # words of a state's context
        for k, at in enumerate(grams.at):
            i = np.flatnonzero(at >= 0)
            first = np.zeros(len(counts), np.int32)
            first[at[i[::-1]]] = i[::-1]
            i = i[(first[at[i]] == i) & (counts[at[i]] > 0)]  # where grams of the training texts occur first
            gram, word = at[i], words[i]
            shorter = grams.at[k - 1][i] if k else None
            context = grams.at[k - 1][i - 1] if k else None
            g = shares[k]
            p[gram] = (1 - g) * counts[gram] / (counts[context] if k else n) + g * (p[shorter] if k else uniform)
            own = word != 0 if k < order - 1 else np.zeros(len(word), bool)
            self.nexts[gram] = np.where(own, gram + 1, np.where(word != 0, self.nexts[shorter] if k else 0, 0))
            self.length[gram + 1] = k + 1
            if k < order - 1:
                self.fails[gram[own] + 1] = self.nexts[shorter[own]] if k else 0
                self.weights[gram[own] + 1] = math.log10(shares[k + 1])
        p[p <= 0] = 1.0
        self.logs = np.log10(p, out=p)
        self.arcs = np.stack([np.where((at >= 0) & (counts[at] > 0), at, -1) for at in grams.at])  # by words of the context and token

    def scores(self, sizes: np.ndarray) -> np.ndarray:
        """The log probability of each text: all are traversed from left to right side by side, in spans of SPAN tokens.

        A span takes up the state of the one before by reading the last words before it, as no state has a longer context.
        """
        reach, starts = len(self.arcs) - 1, np.cumsum(sizes) - sizes
        spans = -(-sizes // SPAN)
        text = np.repeat(np.arange(len(sizes)), spans)
        first = starts[text] + SPAN * (np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans))
        last = np.minimum(first + SPAN, (starts + sizes)[text])
        at, state, total = np.maximum(first - reach, starts[text]), np.zeros(len(text), np.int64), np.zeros(len(text))
        live = np.arange(len(text))
        while len(live):
            now, here, gain = state[live], at[live], np.zeros(len(live))
            todo = np.arange(len(live))
            while len(todo):
                arc = self.arcs[self.length[now[todo]], here[todo]]
                found = arc >= 0
                gain[todo[found]] += self.logs[arc[found]]
                now[todo[found]] = self.nexts[arc[found]]
                todo = todo[~found]
                gain[todo] += self.weights[now[todo]]
                now[todo] = self.fails[now[todo]]
                unknown = now[todo] < 0
                now[todo[unknown]] = 0
                todo = todo[~unknown]
            state[live] = now
            total[live] += np.where(here >= first[live], gain, 0.0)
            at[live] += 1
            live = live[at[live] < last[live]]
        return np.add.reduceat(total, np.cumsum(spans) - spans)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None, parts: int, part: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == part


def score(docs: DataFrame, order: int = ORDER, parts: int = 7, part: int = 2) -> DataFrame:
    """SCORES of every row of docs, under a model of the rows that are not held out: crc32 of doc_id as text, modulo parts, is not part.

    A token is a word, of text with A-Z lower-cased, or the end of a text. base_score adds one to every word's count; n_known
    tokens occur in training. Null and empty texts are one end; a null doc_id is not held out; repeated rows count and are
    scored each for itself; without training texts both scores are 0. Other columns are dropped. docs must give the same rows
    when read again.
    """
    if not 1 <= order <= MAX_ORDER:
        raise ValueError(f"order must be from 1 to {MAX_ORDER}")
    n_buckets = bucket_count(docs)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, BLOCK):
            grams = Grams(texts, order)
            counts = grams.counts(np.array([not held_out(i, parts, part) for i in ids])).astype("<u4")
            found, starts = np.unique(to_bucket(grams.keys, n_buckets), return_index=True)
            ends = np.append(starts[1:], len(grams.keys))
            yield request_batch(block, rows_digest(ids, list(map(len, texts))), {int(b): framed(pack_sorted(grams.keys[s:e]), squeeze(counts[s:e].tobytes())) for b, s, e in zip(found, starts, ends)})

    def add(payloads: list[bytes]) -> tuple[list[bytes], list[int]]:
        asked = [unframed(p) for p in payloads]
        keys = [unpack_sorted(k) for k, _ in asked]
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([np.frombuffer(unsqueeze(c), "<u4") for _, c in asked]), len(unique)).astype(np.uint64)
        sums: list[int] = []
        for k in range(order):
            own = counts[(unique & np.uint64(7)) == k]
            sums += [int(own.sum()), int((own > 0).sum()), int((own == 1).sum())]
        ends = np.cumsum([len(k) for k in keys])
        return [squeeze(counts[inverse[e - len(k) : e]].tobytes()) for k, e in zip(keys, ends)], sums

    scan = docs.select(F.col("doc_id").cast("long"), utf8())
    answers = cut(answer(scan.mapInArrow(ask, REQUESTS), add))
    flat = totals(answers, 3 * order)
    sums = [tuple(flat[3 * k : 3 * k + 3]) for k in range(order)]
    n, kinds, _ = sums[0]

    def traverse(got: list[bytes], block: pa.Table) -> pa.Table:
        ids, texts = block_texts(block)
        grams = Grams(texts, order)
        counts = np.concatenate([np.frombuffer(unsqueeze(a), np.uint64) for a in got]).astype(np.int64)
        automaton = Automaton(grams, counts, sums)
        own = counts[grams.at[0]]
        starts = np.cumsum(grams.sizes) - grams.sizes
        base = np.add.reduceat(np.log10((own + 1) / (n + kinds + 1)), starts)
        known = np.add.reduceat((own > 0).astype(np.int64), starts)
        out = [ids, [held_out(i, parts, part) for i in ids], grams.sizes, known, [n] * len(ids), base, automaton.scores(grams.sizes)]
        return tabled([x.split()[0] for x in SCORES.split(", ")], out, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])

    return meet(answers, block_rows(scan, BLOCK), traverse, SCORES)
