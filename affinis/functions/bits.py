"""Hash codes: bit vectors, integers of up to 63 bits, and words of wider codes."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, functions as F


def popcount(code: Column) -> Column:
    return F.bit_count(code).cast("int")


def hamming(a: Column, b: Column) -> Column:
    return popcount(a.bitwiseXOR(b))


def wide_hamming(a: Column, b: Column) -> Column:
    """Distance of codes kept as arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, hamming), F.lit(0), lambda s, x: s + x)


def to_int(bits: Column) -> Column:
    """Bits, the most significant first, as a number; up to 63 of them."""
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: acc * 2 + b.cast("bigint"))


def to_words(bits: Column, width: int = 62) -> Column:
    """Bits as numbers of ``width`` bits each, for codes wider than a number."""
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bits) / width).cast("int") - 1, F.lit(0)))
    return F.transform(groups, lambda g: to_int(F.slice(bits, g * width + 1, F.lit(width))))


def from_int(code: Column, width: int) -> Column:
    """The ``width`` lowest bits, the most significant first; fails where the number needs more."""
    places = F.array(*[F.lit(width - 1 - i) for i in range(width)])
    bits = F.transform(places, lambda p: F.pmod(F.floor(code / F.pow(F.lit(2.0), p)).cast("bigint"), F.lit(2)).cast("int"))
    return F.when(code < F.lit(1 << width), bits).otherwise(F.raise_error(F.lit(f"more than {width} bits are needed")))


def masks(width: int, distance: int) -> list[int]:
    """All numbers of ``width`` bits with ``distance`` of them set, ascending; none for a distance below 0 or above the width."""
    if distance < 0 or distance > width:
        return []
    out = sorted(sum(1 << i for i in places) for places in combinations(range(width), distance))
    assert len(out) == comb(width, distance)
    return out


def neighbours(code: Column, width: int, distance: int) -> Column:
    """Array of the codes at Hamming distance ``distance``."""
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks(width, distance)]), lambda m: m.bitwiseXOR(code))
