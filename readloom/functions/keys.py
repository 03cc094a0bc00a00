"""Record keys: fixed-width bytes, canonical k-mers and minimizers, and one's own.

k-mers pack two bits a base, A C G T as 0 1 2 3, the first base highest; the canonical value is the lesser of a k-mer and its
reverse complement. A minimizer here is the least canonical k-mer of the read: the order of k-mers is that of their values, so
the least one is the minimizer of every window that holds it, and the window only sets the least length of a read. The minimizers
of all windows are there as well.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.errors import InvalidOption
from readloom.functions.codecs import made_tag

PREFIX_K, MINIMIZER_K, MINIMIZER_W = 31, 31, 15
_ROOM = 31  # the longest k-mer of a signed long


def _upper(sequence: Column) -> Column:
    return F.translate(sequence, "acgt", "ACGT")


def _value(kmer: Column, k: int) -> Column:
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint" if k <= _ROOM else "decimal(20,0)")


def canonical_kmer(kmer: Column, k: int) -> Column:
    """The canonical value of a k-mer of upper-case A, C, G and T: a long, or a decimal where k is 32."""
    return F.least(_value(kmer, k), _value(F.translate(F.reverse(kmer), "ACGT", "TGCA"), k))


def prefix_kmer(sequence: Column, k: int = PREFIX_K) -> Column:
    """The canonical value of the first k bases; null if the read is shorter or one of them is not A, C, G or T."""
    if not 1 <= k <= 32:
        raise InvalidOption("k must be from 1 to 32")
    return F.when(sequence.rlike(f"^[ACGTacgt]{{{k}}}"), canonical_kmer(_upper(F.substr(sequence, F.lit(1), F.lit(k))), k))


def minimizer(sequence: Column, k: int = MINIMIZER_K, w: int = MINIMIZER_W) -> Column:
    """The least canonical k-mer of a read; null if the read has fewer than k + w - 1 bases or any is not A, C, G or T."""
    if not (1 <= k <= 32 and w >= 1):
        raise InvalidOption("k must be from 1 to 32 and w at least 1")
    usable = sequence.rlike(rf"^[ACGTacgt]{{{k + w - 1},}}\z")
    if k > _ROOM:
        upper = _upper(sequence)
        starts = F.sequence(F.lit(1), F.length(sequence) - k + 1)
        return F.when(usable, F.array_min(F.transform(starts, lambda i: canonical_kmer(F.substr(upper, i, F.lit(k)), k))))
    # one pass: each base is pushed into the k-mer and into its reverse complement
    codes = F.split(F.translate(sequence, "ACGTacgt", "01230123"), "")
    long = lambda n: F.lit(n).cast("bigint")
    start = F.struct(long(0).alias("f"), long(0).alias("r"), F.lit(0).alias("n"), long((1 << 63) - 1).alias("least"))

    def push(a: Column, code: Column) -> Column:
        c = code.cast("bigint")
        f = F.shiftleft(a["f"], 2).bitwiseOR(c).bitwiseAND(long((1 << 2 * k) - 1))
        r = F.shiftright(a["r"], 2).bitwiseOR(F.shiftleft(long(3) - c, 2 * (k - 1)))
        least = F.when(a["n"] >= k - 1, F.least(a["least"], f, r)).otherwise(a["least"])
        return F.struct(f.alias("f"), r.alias("r"), (a["n"] + 1).alias("n"), least.alias("least"))

    return F.when(usable, F.aggregate(F.filter(codes, lambda x: x != ""), start, push, lambda a: a["least"]))


def window_minimizers(sequence: Column, k: int = MINIMIZER_K, w: int = MINIMIZER_W) -> Column:
    """The distinct least canonical k-mers of all windows of w k-mers, rising; null where ``minimizer`` is, whose value is the first of them."""
    if not (1 <= k <= 32 and w >= 1):
        raise InvalidOption("k must be from 1 to 32 and w at least 1")
    if k <= _ROOM:
        return F.arrow_udf(lambda texts: _window_minimizers(texts, k, w), "array<bigint>")(sequence)
    upper = _upper(sequence)
    kmers = F.transform(F.sequence(F.lit(1), F.length(sequence) - k + 1), lambda i: canonical_kmer(F.substr(upper, i, F.lit(k)), k))
    least = lambda all_: F.transform(F.sequence(F.lit(1), F.size(all_) - w + 1), lambda i: F.array_min(F.slice(all_, i, w)))
    chosen = F.get(F.transform(F.array(kmers), least), F.lit(0))  # so that k-mers are made once for all windows
    return F.when(sequence.rlike(rf"^[ACGTacgt]{{{k + w - 1},}}\z"), F.array_sort(F.array_distinct(chosen)))


#: Two-bit codes of bases by byte; 4 for any other byte.
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGTacgt", np.uint8)] = [0, 1, 2, 3] * 2
#: Bytes of reads whose windows are taken at once.
STEP = 1 << 20


def _window_minimizers(texts: pa.Array, k: int, w: int) -> pa.Array:
    """``window_minimizers`` of an array of texts, some at a time."""
    texts = texts.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start, counts, found = np.cumsum(sizes), 0, [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    usable = np.zeros(len(sizes), bool)
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + STEP, "right")))
        data = b"".join(t or b"" for t in texts.slice(start, end - start).to_pylist())
        usable[start:end], n, values = _minimizers_of(np.frombuffer(data, np.uint8), sizes[start:end], k, w)
        counts.append(n)
        found.append(values)
        start = end
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=pa.array(~usable))


def _minimizers_of(data: np.ndarray, sizes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, count, values) of reads that stand one after another in data: which have minimizers, how many, and all of them."""
    codes = _CODES[data]
    read = np.repeat(np.arange(len(sizes)), sizes)
    usable = (sizes >= k + w - 1) & (np.bincount(read, codes > 3, len(sizes)) == 0)
    n = len(codes) - k + 1
    windows = n - w + 1
    if windows < 1 or not usable.any():
        return usable, np.zeros(len(sizes), np.int64), np.zeros(0, np.int64)
    codes = (codes & 3).astype(np.int64)
    forward, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        forward = forward << 2 | codes[i : i + n]
        back |= (3 - codes[i : i + n]) << 2 * i
    # least of w neighbours by least of ever longer stretches
    least, held = np.minimum(forward, back), 1
    while held < w:
        step = min(held, w - held)
        least, held = np.minimum(least[:-step], least[step:]), held + step
    inside = np.flatnonzero(usable[read[:windows]] & (read[:windows] == read[k + w - 2 :]))
    read, least = read[inside], least[inside]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (read[1:] != read[:-1])  # most windows share theirs with the one before
    read, least = read[new], least[new]
    order = np.lexsort((least, read))
    read, least = read[order], least[order]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (read[1:] != read[:-1])
    return usable, np.bincount(read[new], minlength=len(sizes)), least[new]


def little_endian(value: Column) -> Column:
    """A k-mer's value as eight bytes, the lowest first. Sorting these does not sort the values."""
    big = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substr(big, F.lit(i), F.lit(2)) for i in range(15, 0, -2))))


def prefix_bytes(sequence: Column, width: int = 8) -> Column:
    """The first bytes of a binary sequence, filled with zeros."""
    return F.rpad(F.substring(sequence, 1, width), width, b"\0")


def xor_bytes(sequence: Column, width: int = 8) -> Column:
    """Each byte of a binary sequence folded by exclusive or into byte i modulo width, as a binary column."""
    rounds = F.ceil(F.length(sequence) / width).cast("int")
    filled = F.rpad(sequence, rounds * width, F.lit(b"\0"))
    zero = F.lit(0).cast("bigint")

    def folded(at: int, size: int) -> Column:
        """The bytes from at on, up to eight, as hexadecimal digits."""
        word = lambda i: F.conv(F.hex(F.substr(filled, i * width + at + 1, F.lit(size))), 16, -10).cast("bigint")
        all_ = F.aggregate(F.sequence(F.lit(0), rounds - 1), zero, lambda a, i: a.bitwiseXOR(word(i)))
        return F.lpad(F.hex(F.when(rounds > 0, all_).otherwise(zero)), 2 * size, "0")

    parts = [folded(at, min(8, width - at)) for at in range(0, width, 8)]
    return F.unhex(F.when(sequence.isNotNull(), F.concat(*parts)).otherwise("00" * width))


@dataclass(frozen=True)
class Key:
    """A kind of key: its width in bytes, how it is derived from a text sequence (None: keys are given), and a tag, made of the name where none is given.

    ``derive`` may give null: the read has no key. A derived number is stored as a number; bytes must have the width and sort as
    intended.
    """

    name: str
    width: int
    derive: Callable[[Column], Column] | None = None
    kmer: bool = False
    given_tag: str | None = None

    @property
    def tag(self) -> str:
        return self.given_tag or made_tag("key", self.name)


_KEYS: dict[str, Key] = {}


def register(key: Key) -> Key:
    if key.name in _KEYS or any(k.tag == key.tag for k in _KEYS.values()):
        raise InvalidOption(f"key {key.name!r} or its tag is taken")
    if key.width < 1 or len(key.tag.encode()) != 16:
        raise InvalidOption("a key has a width of at least 1 and a tag of 16 bytes")
    _KEYS[key.name] = key
    return key


def key(name: str) -> Key:
    if name not in _KEYS:
        raise InvalidOption(f"no key {name!r}; there are {sorted(_KEYS)}")
    return _KEYS[name]


register(Key("bytes8", 8))
register(Key("bytes16", 16))
register(Key("prefix_kmer", 8, prefix_kmer, kmer=True))
register(Key("minimizer", 8, minimizer, kmer=True))
