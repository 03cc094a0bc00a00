"""Codecs of sequences, qualities and names, as pairs of column functions on strings.

``store`` gives what a dataset keeps (None: nothing), ``restore`` the field again, ``size`` the bytes that the packed form takes.
Codecs are kept in registries; ``register`` adds one's own, written with column functions or an Arrow UDF.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.errors import InvalidOption

# The bins of Phred scores, as (first score, score of the bin).
BINS = ((0, 0), (2, 6), (10, 15), (20, 22), (25, 27), (30, 33), (35, 37), (40, 40))


@dataclass(frozen=True)
class Codec:
    """A way to store a field. Its tag of 16 bytes is made of the field and the name where none is given."""

    field: str
    name: str
    store: Callable[[Column], Column | None]
    restore: Callable[[Column], Column]
    size: Callable[[Column], Column]
    lossy: bool = False
    given_tag: str | None = None

    @property
    def tag(self) -> str:
        return self.given_tag or made_tag(self.field, self.name)

    def round_trip(self, column: Column) -> Column:
        """What a field is after it was stored and restored."""
        stored = self.store(column)
        return F.lit("") if stored is None else self.restore(stored)


def made_tag(kind: str, name: str) -> str:
    """16 characters that name a codec or key: its kind's first three, and a digest of its name."""
    return f"{kind[:3]}-{hashlib.md5(name.encode()).hexdigest()[:12]}"


_CODECS: dict[tuple[str, str], Codec] = {}


def register(codec: Codec) -> Codec:
    """Make a codec known by its field and name. A name or tag of the field may be taken only once."""
    if codec.field not in ("sequence", "quality", "name"):
        raise InvalidOption(f"no field {codec.field!r} has codecs")
    if any(c.field == codec.field and (c.name == codec.name or c.tag == codec.tag) for c in _CODECS.values()):
        raise InvalidOption(f"{codec.field} codec {codec.name!r} or its tag is taken")
    if len(codec.tag.encode()) != 16:
        raise InvalidOption("a tag has 16 bytes")
    _CODECS[codec.field, codec.name] = codec
    return codec


def codec(field: str, name: str) -> Codec:
    if (field, name) not in _CODECS:
        raise InvalidOption(f"no {field} codec {name!r}; there are {sorted(n for f, n in _CODECS if f == field)}")
    return _CODECS[field, name]


# --- sequences


def two_bit_exact(sequence: Column) -> Column:
    """What exact two-bit packing gives back: A, C, G and T in upper case, all else as it is."""
    return F.translate(sequence, "acgt", "ACGT")


def two_bit_lossy_n(sequence: Column) -> Column:
    """What lossy two-bit packing gives back: upper-case A, C, G and T, and N for all else."""
    return F.regexp_replace(two_bit_exact(sequence), "[^ACGT]", "N")


def n_ambiguous(sequence: Column) -> Column:
    return F.length(sequence) - F.length(F.regexp_replace(sequence, "[^ACGTacgt]", ""))


def sideband(sequence: Column) -> Column:
    """(pos, base) of each base that is not A, C, G or T, from position 0."""
    bases = F.transform(F.split(sequence, ""), lambda b, i: F.struct(i.alias("pos"), b.alias("base")))
    odd = F.filter(bases, lambda x: ~F.contains(F.lit("ACGTacgt"), x["base"]))  # which contains the empty string at the end as well
    return F.when(n_ambiguous(sequence) > 0, odd).otherwise(F.array().cast("array<struct<pos:int,base:string>>"))


def pack(sequence: Column) -> Column:
    """Two bits a base in 64-bit words as a binary column, the first base highest; other bases count as A, and the last word is filled up.

    The digits are cut into words once, so the work is linear in the length.
    """
    clean = F.translate(F.regexp_replace(two_bit_exact(sequence), "[^ACGT]", "A"), "ACGT", "0123")
    word = lambda digits: F.lpad(F.conv(F.rpad(digits, 32, "0"), 4, 16), 16, "0")
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(clean, F.lit(".{1,32}"), F.lit(0)), word), ""))


def unpack(words: Column, length: Column) -> Column:
    """The bases of ``pack``."""
    digits = F.transform(F.regexp_extract_all(F.hex(words), F.lit(".{16}"), F.lit(0)), lambda w: F.lpad(F.conv(w, 16, 4), 32, "0"))
    return F.substr(F.translate(F.array_join(digits, ""), "0123", "ACGT"), F.lit(1), length)


def _with_bases(text: Column, odd: Column, base: Callable[[Column], Column], pos: Callable[[Column], Column]) -> Column:
    put = lambda s, x: F.overlay(s, base(x), pos(x) + 1, F.lit(1))
    return F.when(F.size(odd) == 0, text).otherwise(F.aggregate(odd, text, put))


def _store_exact(s: Column) -> Column:
    return F.struct(F.length(s).alias("length"), pack(s).alias("words"), sideband(s).alias("odd"))


def _restore_exact(c: Column) -> Column:
    return _with_bases(unpack(c["words"], c["length"]), c["odd"], lambda x: x["base"], lambda x: x["pos"])


def _store_lossy(s: Column) -> Column:
    return F.struct(F.length(s).alias("length"), pack(s).alias("words"), F.transform(sideband(s), lambda x: x["pos"]).alias("odd"))


def _restore_lossy(c: Column) -> Column:
    return _with_bases(unpack(c["words"], c["length"]), c["odd"], lambda x: F.lit("N"), lambda x: x)


def _packed_size(each: int) -> Callable[[Column], Column]:
    return lambda s: 8 * F.ceil(F.length(s) / 32).cast("int") + 4 + each * n_ambiguous(s)


def run_lengths(sequence: Column) -> Column:
    """(base, count) of the runs of a sequence, longer ones split so that a count fits a byte."""
    whole = F.regexp_extract_all(sequence, F.lit(r"(?s)((.)\2*)"), 1)
    split = F.transform(whole, lambda r: F.transform(F.sequence(F.lit(0), ((F.length(r) - 1) / 255).cast("int")), lambda i: F.struct(F.left(r, F.lit(1)).alias("base"), F.least(F.lit(255), F.length(r) - i * 255).alias("count"))))
    return F.when(F.length(sequence) > 0, F.flatten(split)).otherwise(F.array().cast("array<struct<base:string,count:int>>"))


def from_run_lengths(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda x: F.repeat(x["base"], x["count"])), "")


# --- qualities

_SOURCE = "".join(map(chr, range(256)))


def bin_of(code: int) -> str:
    """The character of a score's bin, for a character code."""
    score = max(0, code - 33)
    return chr(33 + [to for first, to in BINS if first <= score][-1])


_BINNED = "".join(map(bin_of, range(256)))


def binned(quality: Column) -> Column:
    """Phred+33 scores as those of their bins; of the same length, and unchanged if done again."""
    return F.translate(quality, _SOURCE, _BINNED)


# --- names


def split_name(name: Column) -> Column:
    """(id, description): a name before and after its first space."""
    at = F.instr(name, " ")
    return F.struct(F.substring_index(name, " ", 1).alias("id"), F.when(at > 0, F.substr(name, at + 1)).otherwise("").alias("description"))


def join_name(parts: Column) -> Column:
    """A name from its parts. A description that was empty leaves no space."""
    return F.when(parts["description"] == "", parts["id"]).otherwise(F.concat(parts["id"], F.lit(" "), parts["description"]))


_same = lambda c: c
_nothing = lambda c: None
_none = lambda c: F.lit(0)
_empty = lambda c: F.lit("")

register(Codec("sequence", "raw", _same, _same, F.length))
register(Codec("sequence", "omitted", _nothing, _empty, _none, lossy=True))
register(Codec("sequence", "two_bit_exact", _store_exact, _restore_exact, _packed_size(5)))
register(Codec("sequence", "two_bit_lossy_n", _store_lossy, _restore_lossy, _packed_size(4), lossy=True))
register(Codec("sequence", "run_length", run_lengths, from_run_lengths, lambda s: 2 * F.size(run_lengths(s))))
register(Codec("sequence", "upper", lambda s: F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _same, F.length, lossy=True))
register(Codec("quality", "raw", _same, _same, F.length))
register(Codec("quality", "binned", binned, _same, F.length, lossy=True))
register(Codec("quality", "omitted", _nothing, _empty, _none, lossy=True))
register(Codec("name", "raw", _same, _same, F.length))
register(Codec("name", "omitted", _nothing, _empty, _none, lossy=True))
register(Codec("name", "split", split_name, join_name, lambda n: 4 + F.length(n) - (F.instr(n, " ") > 0).cast("int")))
