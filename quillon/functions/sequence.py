"""Sequence functions as SQL expressions: reverse complement, rotations, canonical units, match frequency."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every IUPAC letter but A, C, G and T complements to N.
_LETTERS, _COMPLEMENTS = "ACGTMRWSYKVHDBN=", "TGCANNNNNNNNNNNN"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_col(seq)), _LETTERS, _COMPLEMENTS)


def min_rotation(unit: Column | str) -> Column:
    """The least rotation in byte order; empty for an empty unit."""
    unit = _col(unit)
    n = F.length(unit)
    twice = F.concat(unit, unit)
    rotations = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(twice, i, n))
    return F.array_min(rotations)


def canonical_unit(unit: Column | str) -> Column:
    """The lesser of the least rotations of a unit and of its reverse complement."""
    unit = _col(unit)
    return F.least(min_rotation(unit), min_rotation(reverse_complement(unit)))


def matches_at_offset(seq: Column | str, offset: Column | int) -> Column:
    """How many letters equal the one offset places on; 0 when the offset is more than half the length."""
    seq = _col(seq)
    offset = F.lit(offset) if isinstance(offset, int) else offset
    n = F.length(seq)
    places = F.sequence(F.lit(1), F.greatest(n - offset, F.lit(1)))
    same = F.size(F.filter(places, lambda i: F.substring(seq, i, F.lit(1)) == F.substring(seq, i + offset, F.lit(1)))).cast("long")
    return F.when(offset <= F.floor(n / 2), same).otherwise(F.lit(0).cast("long"))


def match_frequency(seq: Column | str, offset: Column | int) -> Column:
    seq = _col(seq)
    offset_ = F.lit(offset) if isinstance(offset, int) else offset
    room = F.length(seq) - offset_
    return F.when(offset_ <= F.floor(F.length(seq) / 2), matches_at_offset(seq, offset) / room).otherwise(F.lit(0.0))
