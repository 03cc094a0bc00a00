"""Sets of fields, joined with |, and projection to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from readloom.errors import InvalidOption

ORDER = ("name", "sequence", "quality", "key")


@dataclass(frozen=True)
class Fields:
    names: frozenset[str]

    def __or__(self, other: Fields) -> Fields:
        return Fields(self.names | other.names)

    def columns(self) -> list[str]:
        return [c for c in ORDER if c in self.names]


def fields(*names: str) -> Fields:
    """A set of fields by their names: at least one, and known ones only."""
    if not names or set(names) - set(ORDER):
        raise InvalidOption(f"fields are {', '.join(ORDER)}, not {names}")
    return Fields(frozenset(names))


NAME, SEQUENCE, QUALITY, KEY = map(fields, ORDER)
ALL = NAME | SEQUENCE | QUALITY | KEY
#: All projections that are not empty, by a name made of their fields.
PROJECTIONS = {"_".join(f.columns()): f for n in range(1, 16) for f in [fields(*(c for i, c in enumerate(ORDER) if n >> i & 1))]}


def project(reads: DataFrame, chosen: Fields) -> DataFrame:
    """The chosen columns only; the scan below reads no others. An unknown column fails when the plan is analyzed."""
    return reads.select(*chosen.columns())
