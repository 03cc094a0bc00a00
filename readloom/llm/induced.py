"""Suffix sorting by recursive induction in external memory, with common prefixes.

Suffixes that start a rising stretch after a falling one (LMS suffixes) are sorted by recursion, and two sweeps in suffix order
induce all others from them. A sweep takes suffix tuples from a priority queue by symbol; each puts the suffix before it into
the queue. A tuple carries its position, the length of its common prefix with the tuple that came before it under the same
symbol, the run of its first symbol, and the symbols before it, so a sweep reads the text but once every few steps. LMS
substrings are named by sorting them a few symbols at a time, or, where they are too many to be held in memory, by the same two
sweeps over unsorted seeds: their order and their common prefixes give the names.

Queues, logs and tables are on disk beyond a bound on what they hold in memory; the files are unlinked ones of the task. Many
small symbols are taken in one step, as long as none of them gets new tuples by it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that each queue, log and table holds in memory.
HELD = 16 << 20
#: Tuples that one step of a sweep takes at most.
PIECE = 1 << 16
#: Runs of a queue after which the youngest are merged.
RUNS = 24
#: Symbols before a suffix that a tuple carries.
CARRIED = 4
NEVER, TOP = -1, np.iinfo(np.int64).max
#: ahead: the symbols before the suffix, the nearest lowest, under a set bit; 1, or 0, if there are none.
TUPLE = np.dtype([("pos", "<i8"), ("ahead", "<u8"), ("lcp", "<i4"), ("run", "<i4")])
ENTRY = np.dtype([("symbol", "<i8"), ("pos", "<i8"), ("lcp", "<i4"), ("run", "<i4")])


def table(n: int, kind: str, held: int = HELD) -> np.ndarray:
    """n zeros, in a file if they take more than held bytes."""
    if n * np.dtype(kind).itemsize <= held:
        return np.zeros(n, kind)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(kind).itemsize)
    return np.memmap(file, kind, "r+", shape=(n,))


class Log:
    """Records in the order in which they were put; they can be read from either end."""

    def __init__(self, kind: np.dtype | str, held: int = HELD):
        self.kind, self.held, self.size, self.parts, self.count = np.dtype(kind), held, 0, [], 0
        self.file = None

    def put(self, records: np.ndarray) -> None:
        if not len(records):
            return
        self.parts.append(records)
        self.count += len(records)
        self.size += records.nbytes
        if self.size > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for i, part in enumerate(self.parts):
                if isinstance(part, np.ndarray):
                    self.parts[i] = (self.file.tell(), len(part))
                    self.file.write(part.tobytes())
            self.size = 0

    def pieces(self, backwards: bool = False) -> Iterator[np.ndarray]:
        for part in reversed(self.parts) if backwards else self.parts:
            if not isinstance(part, np.ndarray):
                self.file.seek(part[0])
                part = np.frombuffer(self.file.read(part[1] * self.kind.itemsize), self.kind)
            yield part[::-1] if backwards else part


class Queue:
    """A priority queue of tuples by symbol, first in first out among equal ones: sorted runs, the oldest first, merged as they grow."""

    def __init__(self, held: int = HELD):
        self.runs: list[list] = []  # symbols, tuples, next place
        self.held, self.free = held, held

    def _run(self, symbols: np.ndarray, tuples: np.ndarray) -> list:
        size = symbols.nbytes + tuples.nbytes
        in_memory = sum(s.nbytes + t.nbytes for s, t, _ in self.runs if not isinstance(s, np.memmap))
        if in_memory + size > self.held:
            s, t = table(len(symbols), "<i8", 0), table(len(tuples), TUPLE, 0)
            s[:], t[:] = symbols, tuples
            symbols, tuples = s, t
        return [symbols, tuples, 0]

    def put(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        self.runs.append(self._run(symbols[order], tuples.take(order)))
        if len(self.runs) > RUNS:
            self._merge()

    def _merge(self) -> None:
        """Make one of the youngest runs, as many as may be held in memory, but not of one that is larger than all of these."""
        k, size = 0, 0
        for s, _, at in reversed(self.runs):
            if (size + len(s) - at) * 32 > self.held or k > RUNS // 2 and len(s) - at > size:
                break
            k, size = k + 1, size + len(s) - at
        if k > 1:
            some, self.runs = self.runs[-k:], self.runs[:-k]
            symbols, tuples = np.concatenate([s[at:] for s, _, at in some]), np.concatenate([t[at:] for _, t, at in some])
            order = np.argsort(symbols, kind="stable")
            self.runs.append(self._run(symbols[order], tuples.take(order)))

    def back(self, symbols: np.ndarray, tuples: np.ndarray) -> None:
        """Put sorted tuples back that were taken last."""
        if len(symbols):
            self.runs.insert(0, [symbols, tuples, 0])

    def first(self) -> int:
        return min((int(s[at]) for s, _, at in self.runs), default=TOP)

    def bound(self, n: int) -> int:
        """A symbol below which there are no more than n tuples, if the first symbol alone has not more."""
        each = max(1, n // max(1, len(self.runs)))
        return min((int(s[at + each]) for s, _, at in self.runs if at + each < len(s)), default=TOP)

    def take(self, bound: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The tuples below a symbol, in order; with most, no more than so many of the oldest, which must all have the first symbol."""
        got, left = [], most
        for run in self.runs:
            symbols, tuples, at = run
            end = at + int(np.searchsorted(symbols[at:], bound))
            if left is not None:
                end = min(end, at + left)
                left -= end - at
            if end > at:
                got.append((symbols[at:end], tuples[at:end]))
                run[2] = end
        self.runs = [r for r in self.runs if r[2] < len(r[0])]
        if not got:
            return np.zeros(0, np.int64), np.zeros(0, TUPLE)
        if len(got) == 1:
            return np.array(got[0][0]), np.array(got[0][1])
        symbols, tuples = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        if most is None:
            order = np.argsort(symbols, kind="stable")
            symbols, tuples = symbols[order], tuples.take(order)
        return symbols, tuples


class Stream:
    """Entries that come in order of their symbols, taken in pieces."""

    def __init__(self, pieces: Iterator[np.ndarray]):
        self.pieces, self.held = pieces, np.zeros(0, ENTRY)

    def _fill(self, n: int) -> None:
        while len(self.held) <= n:
            more = next(self.pieces, None)
            if more is None:
                return
            self.held = np.concatenate([self.held, more]) if len(self.held) else more

    def first(self) -> int:
        self._fill(0)
        return int(self.held["symbol"][0]) if len(self.held) else TOP

    def bound(self, n: int) -> int:
        self._fill(n)
        return int(self.held["symbol"][n]) if len(self.held) > n else TOP

    def take(self, bound: int, most: int) -> np.ndarray:
        self._fill(most)
        n = min(most, int(np.searchsorted(self.held["symbol"][: most + 1], bound)))
        got, self.held = self.held[:n], self.held[n:]
        return got

    def back(self, entries: np.ndarray) -> None:
        self.held = np.concatenate([entries, self.held])


def range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair, by a table of powers of two."""
    out = np.zeros(len(first), values.dtype)
    size = last - first + 1
    level, row = 0, values
    while True:
        now = (size >> level) == 1
        if now.any():
            out[now] = np.minimum(row[first[now]], row[last[now] + 1 - (1 << level)])
        if len(size) == 0 or size.max() >> (level + 1) == 0:
            return out
        row = np.minimum(row[: len(row) - (1 << level)], row[1 << level :])
        level += 1


class Sweep:
    """One pass in suffix order, upwards for falling suffixes or downwards for rising ones, which it induces from a stream of others."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int, down: bool, held: int):
        self.text, self.symbols, self.depth, self.down = text, symbols, depth, down
        self.bits = max(1, int(symbols - 1).bit_length())
        self.carried = min(CARRIED, 63 // self.bits)
        self.queue = Queue(held)
        self.last = table(symbols, "<i8", held)  # one more than the step at which a symbol got its last tuple
        self.seen = np.full(depth + 1, NEVER)  # the last step with each common prefix
        self.step, self.before = 0, (NEVER, 0, False)

    def _key(self, symbols: np.ndarray) -> np.ndarray:
        return self.symbols - 1 - symbols if self.down else symbols

    def _ahead(self, tuples: np.ndarray) -> np.ndarray:
        """The symbol before each tuple, as a key; TOP for the first suffix of the text. Tuples that carry none read some."""
        pos, ahead = tuples["pos"], tuples["ahead"]
        dry = np.flatnonzero((ahead <= 1) & (pos > 0))
        if len(dry):
            at, bits = pos[dry], np.uint64(self.bits)
            n = np.minimum(at, self.carried)
            some = np.ones(len(dry), np.uint64)
            for k in range(self.carried, 0, -1):  # the farthest first
                more = some << bits | self.text[np.maximum(at - k, 0)].astype(np.uint64)
                some = np.where(n >= k, more, some)
            ahead[dry] = some
        symbol = (ahead & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return np.where(pos > 0, self._key(symbol), TOP)

    def _merged(self, symbols: np.ndarray, tuples: np.ndarray, entries: np.ndarray):
        fresh = np.zeros(len(entries), TUPLE)
        for name in ("pos", "lcp", "run"):
            fresh[name] = entries[name]
        if not len(entries):
            return symbols, tuples, np.ones(len(symbols), bool)
        if not len(symbols):
            return entries["symbol"], fresh, np.zeros(len(entries), bool)
        both = np.concatenate([symbols, entries["symbol"]])
        order = np.argsort(both, kind="stable")
        return both[order], np.concatenate([tuples, fresh]).take(order), order < len(symbols)

    def __call__(self, stream: Stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(entries, whether each was induced, whether each is an LMS suffix) in the order of the sweep; an entry's lcp is the one with the entry before."""
        room, queue = PIECE, self.queue
        while (c := min(queue.first(), stream.first())) < TOP:
            bound = max(c + 1, min(queue.bound(room), stream.bound(room)))
            if bound > c + 1:
                some, entries = queue.take(bound), stream.take(bound, room)
                symbols, tuples, induced = self._merged(*some, entries)
                target = self._ahead(tuples)
                goes = (target > symbols) & (target < TOP) | (target == symbols) & induced
                least = np.minimum.accumulate(np.where(goes, target, TOP))
                wrong = np.flatnonzero(symbols >= least)
                if not len(wrong):
                    yield self._step(symbols, tuples, induced, target, goes)
                    room = min(PIECE, 2 * room)
                    continue
                x = int(symbols[wrong[0]])
                n = int(np.searchsorted(symbols, x))
                room = max(32, min(PIECE, 2 * n))
                rest = induced[n:]
                queue.back(symbols[n:][rest], tuples[n:][rest])
                stream.back(entries[int(np.searchsorted(entries["symbol"], x)) :])
                if n:
                    yield self._step(symbols[:n], tuples[:n], induced[:n], target[:n], goes[:n])
                    continue
            if queue.first() == c:  # one symbol, which may go on getting tuples
                symbols, tuples = queue.take(c + 1, PIECE)
                entries = np.zeros(0, ENTRY)
            else:
                symbols, tuples, entries = np.zeros(0, np.int64), np.zeros(0, TUPLE), stream.take(c + 1, PIECE)
            symbols, tuples, induced = self._merged(symbols, tuples, entries)
            target = self._ahead(tuples)
            yield self._step(symbols, tuples, induced, target, (target > symbols) & (target < TOP) | (target == symbols) & induced)

    def _step(self, symbols: np.ndarray, tuples: np.ndarray, induced: np.ndarray, target: np.ndarray, goes: np.ndarray):
        n, (symbol, run, was) = len(symbols), self.before
        old_symbol, old_run, old = np.append(symbol, symbols[:-1]), np.append(run, tuples["run"][:-1]), np.append(was, induced[:-1])
        lcp = np.where(symbols != old_symbol, 0, np.where(old == induced, tuples["lcp"], np.minimum(old_run, tuples["run"])))
        self.before = int(symbols[-1]), int(tuples["run"][-1]), bool(induced[-1])

        at = np.flatnonzero(goes)
        order = at[np.argsort(target[at], kind="stable")]
        t = target[order]
        again = np.zeros(len(order), bool)
        again[1:] = t[1:] == t[:-1]
        common = np.zeros(len(order), np.int64)
        a, b = order[:-1][again[1:]], order[1:][again[1:]]
        common[again] = range_min(lcp, a + 1, b)
        head = np.flatnonzero(~again)
        last = np.asarray(self.last[t[head]]) - 1
        past = np.searchsorted(np.maximum.accumulate(self.seen), last, "right")
        common[head] = np.minimum(past, np.minimum.accumulate(lcp)[order[head]])
        shared = np.minimum(self.depth, 1 + common)
        shared[head[last == NEVER]] = 0
        ends = np.append(head[1:], len(order))[: len(head)] - 1
        self.last[t[head]] = self.step + order[ends] + 1
        self.seen[lcp] = self.step + np.arange(n)
        self.step += n

        new = np.zeros(len(order), TUPLE)
        from_ = tuples.take(order)
        new["pos"], new["ahead"] = from_["pos"] - 1, from_["ahead"] >> np.uint64(self.bits)
        new["lcp"] = shared
        new["run"] = np.where(t == symbols[order], np.minimum(self.depth, from_["run"] + 1), 1)
        self.queue.put(t, new)
        out = np.zeros(n, ENTRY)
        out["symbol"], out["pos"], out["lcp"], out["run"] = self._key(symbols), tuples["pos"], lcp, tuples["run"]
        return out, induced, induced & (target < symbols)


def lms(text: np.ndarray, held: int = HELD) -> np.ndarray:
    """The places of the LMS suffixes of text, rising; the last suffix is one."""
    n, block = len(text), 4 * PIECE
    found, rises = Log("<i8", held), True
    found.put(np.array([n - 1]))
    for end in range(n - 1, 0, -block):
        start = max(0, end - block)
        step = np.diff(text[start : end + 1].astype(np.int64))
        at = np.where(step != 0, np.arange(len(step)), len(step))
        at = np.minimum.accumulate(at[::-1])[::-1]
        up = np.append(np.append(step, 1 if rises else -1)[at] > 0, rises)
        found.put((np.flatnonzero(up[1:] & ~up[:-1]) + start + 1)[::-1])
        rises = bool(up[0])
    out, at = table(found.count, "<i8", held), found.count
    for part in found.pieces():
        part = part[part < n - 1] if at < found.count else part
        at -= len(part)
        out[at : at + len(part)] = part[::-1]
    return out[at:]


def _runs(text: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """How often the symbol at each place is repeated from there, up to depth."""
    out, live, k = np.ones(len(pos), np.int64), np.arange(len(pos)), 1
    while len(live) and k < depth:
        live = live[pos[live] + k < len(text)]
        live = live[text[pos[live] + k] == text[pos[live]]]
        out[live] += 1
        k += 1
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of the suffixes at each two places, of which some is known, up to depth."""
    out = np.minimum(known, depth)
    live = np.flatnonzero(out < depth)
    while len(live):
        live = live[np.maximum(a[live], b[live]) + out[live] < len(text)]
        live = live[text[a[live] + out[live]] == text[b[live] + out[live]]]
        out[live] += 1
        live = live[out[live] < depth]
    return out


def _small(text: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """What ``suffixes`` gives, for a text that fits in memory: ranks of doubled length, which give the common prefixes as well."""
    rank, k = np.asarray(text).astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    rank[order] = np.append(0, np.cumsum(rank[order[1:]] != rank[order[:-1]]))
    ranks = [rank.astype(np.int32)]
    while k < min(depth, len(rank)) and rank[order[-1]] + 1 < len(rank):
        after = np.append(rank[k:], np.full(min(k, len(rank)), NEVER))[: len(rank)]
        order = np.argsort(rank * (len(rank) + 1) + after + 1, kind="stable")
        changed = (rank[order[1:]] != rank[order[:-1]]) | (after[order[1:]] != after[order[:-1]])
        rank = np.empty_like(rank)
        rank[order] = np.append(0, np.cumsum(changed))
        ranks.append(rank.astype(np.int32))
        k *= 2
    order = order[order < len(rank) - 1]
    a, b, common = order[1:], order[:-1], np.zeros(max(0, len(order) - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):  # the last suffix, a symbol of its own, ends every common prefix
        live = np.flatnonzero(np.maximum(a, b) + common < len(rank) - 1)
        live = live[ranks[level][a[live] + common[live]] == ranks[level][b[live] + common[live]]]
        common[live] += 1 << level
    out = np.zeros(len(order), ENTRY)
    out["pos"] = order[::-1]
    out["lcp"][1:] = np.minimum(common, depth)[::-1]
    yield out


def _seeds(text: np.ndarray, pos: np.ndarray, lcp: np.ndarray, runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(pos), ENTRY)
    out["symbol"], out["pos"], out["lcp"], out["run"] = text[pos], pos, lcp, runs
    return out


def _induce(text: np.ndarray, symbols: int, depth: int, seeds: Iterator[np.ndarray], held: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, which are LMS suffixes) of all suffixes but the last one, downwards, from seeds upwards."""
    falling = Log(ENTRY, held)
    for entries, induced, _ in Sweep(text, symbols, depth, False, held)(Stream(seeds)):
        falling.put(entries[induced])

    def backwards() -> Iterator[np.ndarray]:
        after = 0  # the common prefix with the entry that was given before
        for part in falling.pieces(backwards=True):
            out = np.array(part)
            out["lcp"] = np.append(after, part["lcp"][:-1])
            out["symbol"] = symbols - 1 - part["symbol"]
            after = part["lcp"][-1]
            yield out

    for entries, _, starts in Sweep(text, symbols, depth, True, held)(Stream(backwards())):
        yield entries, starts


def _sorted_names(text: np.ndarray, starts: np.ndarray, symbols: int, depth: int, held: int) -> tuple[np.ndarray, int]:
    """(the name of each LMS substring in the order of the text, 0 for the last suffix; how many there are), in memory.

    What follows the end of a substring counts as greater than any symbol: a longer substring falls where the shorter one ends.
    """
    starts = np.asarray(starts)
    pos, size = starts[:-1], np.diff(starts) + 1
    bits = int(symbols).bit_length()
    step = max(1, 63 // bits)
    rank, live, at = np.zeros(len(pos), np.int64), np.arange(len(pos)), 0
    while len(live) and at < depth:
        first, long = pos[live], size[live]
        key = np.zeros(len(live), np.int64)
        for k in range(at, at + step):
            key = key << bits | np.where(k < long, text[np.minimum(first + k, len(text) - 1)], symbols)
        order = np.lexsort((key, rank[live])) if at else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old = rank[live]
        run = np.append(True, old[1:] != old[:-1])
        group = run | np.append(True, key[1:] != key[:-1])
        place = np.arange(len(live))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank[live] = old + start - np.maximum.accumulate(np.where(run, place, 0))
        many = np.bincount(start, minlength=len(live))[start] > 1
        at += step
        live = live[many & (size[live] > at)]
    kinds, names = np.unique(rank, return_inverse=True)
    return np.append(names + 1, 0), len(kinds)


def _induced_names(text: np.ndarray, starts: np.ndarray, symbols: int, depth: int, held: int) -> tuple[np.ndarray, int]:
    """What ``_sorted_names`` gives, by sweeps over seeds that are sorted by their first symbol alone."""
    m = len(starts)
    names = table(len(text) // 2 + 1, "<i8", held)  # at half the place of an LMS suffix, as no two are neighbours
    count, last_pos, low = 0, None, depth
    for entries, is_start in _induce(text, symbols, depth, _rough(text, starts, held), held):
        at = np.flatnonzero(is_start)
        if not len(at):
            low = min(low, int(entries["lcp"].min())) if len(entries) else low
            continue
        least = np.minimum.reduceat(entries["lcp"][: at[-1] + 1], np.append(0, at[:-1] + 1)).astype(np.int64)  # since the LMS suffix before
        least[0] = min(least[0], low)
        pos = entries["pos"][at]
        index = np.searchsorted(starts, pos)
        size = np.asarray(starts[index + 1]) - pos + 1
        if last_pos is None:
            same = np.zeros(len(pos), bool)
            same[1:] = (least[1:] >= depth) | (least[1:] == size[1:]) & (size[1:] == size[:-1])
        else:
            old = np.append(last_pos, size[:-1])
            same = (least >= depth) | (least == size) & (size == old)
        names[pos >> 1] = count + np.cumsum(~same)
        count = int(names[pos[-1] >> 1])
        last_pos = int(size[-1])
        low = int(entries["lcp"][at[-1] + 1 :].min()) if at[-1] + 1 < len(entries) else depth
    reduced = table(m, "<i8", held)
    for i in range(0, m - 1, PIECE):
        j = min(m - 1, i + PIECE)
        reduced[i:j] = count + 1 - names[np.asarray(starts[i:j]) >> 1]
    return reduced, count


def suffixes(text: np.ndarray, symbols: int, depth: int, held: int = HELD) -> Iterator[np.ndarray]:
    """The suffixes of text from the greatest to the least, as entries whose lcp is the common prefix with the one before, up to depth.

    text: numbers below symbols, the last one 0 and no other; that last suffix is not given. Suffixes that agree in depth
    symbols are in no particular order. text may be in a file. Memory is bounded by a few times held, but for a text whose tables
    fit in it.
    """
    n = len(text)
    starts = lms(text, held)
    m = len(starts)
    if m > 1:
        small = m * 16 <= held
        reduced, count = (_sorted_names if small else _induced_names)(text, starts, symbols, depth, held)
        order = Log(ENTRY, held)
        names_depth = depth // 2 + 1
        if count == m - 1:
            place = table(m, "<i8", held)
            for i in range(0, m - 1, PIECE):
                j = min(m - 1, i + PIECE)
                place[reduced[i:j]] = np.arange(i, j)
            for i in range(m - 1, 0, -PIECE):
                part = np.zeros(len(place[max(1, i - PIECE + 1) : i + 1]), ENTRY)
                part["pos"] = place[max(1, i - PIECE + 1) : i + 1][::-1]
                order.put(part)
        else:
            for part in _small(reduced, names_depth) if small else suffixes(reduced, count + 1, names_depth, held):
                order.put(part)
    else:
        order = Log(ENTRY, held)

    def seeds() -> Iterator[np.ndarray]:
        yield _seeds(text, np.array([n - 1]), np.zeros(1, np.int64), np.ones(1, np.int64))
        before, shared = None, 0  # the seed before, and how many names it shares with the next one
        for part in order.pieces(backwards=True):
            index = part["pos"]
            pos = np.asarray(starts[index])
            old = np.append(before if before is not None else index[0], index[:-1])
            names_shared = np.append(shared, part["lcp"][:-1])
            known = np.asarray(starts[np.minimum(old + names_shared, m - 1)]) - np.asarray(starts[old])
            lcp = _common(text, np.asarray(starts[old]), pos, known, depth)
            if before is None:
                lcp[0] = 0
            before, shared = int(index[-1]), int(part["lcp"][-1])
            yield _seeds(text, pos, lcp, _runs(text, pos, depth))

    for entries, _ in _induce(text, symbols, depth, seeds(), held):
        yield entries


def _rough(text: np.ndarray, starts: np.ndarray, held: int) -> Iterator[np.ndarray]:
    """LMS suffixes by their first symbol alone, as seeds that share no more than it."""
    queue = Queue(held)
    for i in range(0, len(starts), PIECE):
        some = np.zeros(len(starts[i : i + PIECE]), TUPLE)
        some["pos"] = starts[i : i + PIECE]
        queue.put(text[some["pos"]].astype(np.int64), some)
    before = NEVER
    while (c := queue.first()) < TOP:
        bound = queue.bound(PIECE)
        pos = queue.take(bound)[1]["pos"] if bound > c else queue.take(c + 1, PIECE)[1]["pos"]
        symbol = text[pos].astype(np.int64)
        same = np.append(before, symbol[:-1]) == symbol
        before = int(symbol[-1])
        yield _seeds(text, pos, same.astype(np.int64), np.ones(len(pos), np.int64))
