"""Descriptor generators: from elements to vectors, computed once for each uid.

A generator is a function of DataFrames. It gets elements ``(uid, content, content_type)`` of its content types and gives ``(uid, vector)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from affinis.operators import sets
from affinis.sources import files

from .registry import Registry

GENERATORS = Registry("descriptor generators")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Generator:
    """Describes elements of its content ``types``; null means any."""

    types: list[str] | None = None

    def vector(self, content: Column) -> Column:
        """The descriptor of a content, null where there is none."""
        raise NotImplementedError

    def describe(self, elements: DataFrame) -> DataFrame:
        return elements.select("uid", self.vector(F.col("content")).alias("vector"))


@GENERATORS.add(name="letters")
class Letters(Generator):
    """Shares of the 26 letters, in either case, among a text's characters."""

    types = ["text/plain"]

    def vector(self, content: Column) -> Column:
        text = F.lower(content.cast("string"))
        size = F.char_length(text)
        shares = F.array(*[(size - F.char_length(F.replace(text, F.lit(c), F.lit("")))) / size for c in LETTERS])
        return F.when(size > 0, shares)


@GENERATORS.add(name="hashed_words")
class HashedWords(Generator):
    """Shares of a text's words by hash, in ``width`` bins."""

    types = ["text/plain"]

    def __init__(self, width: int = 64):
        self.width = width

    def vector(self, content: Column) -> Column:
        words = F.regexp_extract_all(F.lower(content.cast("string")), F.lit(r"\S+"), F.lit(0))
        bins = F.transform(words, lambda w: F.crc32(w) % self.width)
        shares = F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.size(F.filter(bins, lambda b: b == i)) / F.size(bins))
        return F.when(F.size(words) > 0, shares)


@GENERATORS.add(name="byte_histogram")
class ByteHistogram(Generator):
    """Shares of the 16 values that the upper half of a content's bytes takes."""

    def vector(self, content: Column) -> Column:
        digits = F.hex(content.cast("binary"))
        halves = F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(2)), lambda i: F.substring(digits, i, F.lit(1)))
        values = F.array(*[F.lit(f"{n:X}") for n in range(16)])
        shares = F.transform(values, lambda v: F.size(F.filter(halves, lambda h: h == v)) / F.size(halves))
        return F.when(F.length(digits) > 0, shares)


def compute(elements: DataFrame, generator: Generator, done: DataFrame | None = None, overwrite: bool = False, strict: bool = False) -> DataFrame:
    """``(uid, vector)`` of all ``elements (uid, content, content_type)`` that the generator can describe, each uid once.

    Descriptors in ``done (uid, vector)`` are kept and not computed again, unless ``overwrite``. ``strict`` fails on an element of another type. Contents
    without a descriptor, such as empty ones, are left out.
    """
    fit = elements if generator.types is None else files.of_type(elements, generator.types, strict)
    todo = files.data_set(fit) if done is None else sets.not_computed(files.data_set(fit), done.select("uid"), "uid", overwrite)
    new = generator.describe(todo).where(F.col("vector").isNotNull())
    if done is None:
        return new
    return sets.upsert(done.select("uid", "vector"), new, "uid") if overwrite else done.select("uid", "vector").unionByName(new)


def compute_transformed(elements: DataFrame, transforms: dict[str, Callable[[Column], Column]], generator: Generator) -> DataFrame:
    """``(uid, transform, vector)`` of every element under every named function of its content, in one pass over the elements."""
    fit = elements if generator.types is None else files.of_type(elements, generator.types)
    each = F.array(*[F.struct(F.lit(name).alias("transform"), generator.vector(f(F.col("content"))).alias("vector")) for name, f in transforms.items()])
    return files.data_set(fit).select("uid", F.inline(each)).where(F.col("vector").isNotNull())
