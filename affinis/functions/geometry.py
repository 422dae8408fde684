"""Axis-aligned boxes in any number of dimensions, crop grids and image transforms' parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .vec import total  # noqa: F401


def valid(low: Column, high: Column) -> Column:
    """Vertices of equal width, none of the low ones above the high ones."""
    return (F.size(low) == F.size(high)) & F.forall(F.zip_with(low, high, lambda a, b: a <= b), lambda x: x)


def deltas(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: b - a)


def hypervolume(low: Column, high: Column) -> Column:
    return F.aggregate(deltas(low, high), F.lit(1.0), lambda acc, x: acc * x)


def intersection(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Struct of the common box's vertices, null if any of its sides isn't positive."""
    low, high = F.zip_with(low_a, low_b, lambda x, y: F.greatest(x, y)), F.zip_with(high_a, high_b, lambda x, y: F.least(x, y))
    return F.when(F.array_min(deltas(low, high)) > 0, F.struct(low.alias("low"), high.alias("high")))


def near(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether vertices are about equal."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda x: x)


def crop_fits(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A crop of positive area inside an image."""
    return (left >= 0) & (top >= 0) & (right <= width) & (bottom <= height) & (left < right) & (top < bottom)


def centre_crops(images: DataFrame, n: int) -> DataFrame:
    """``n`` nested crops of each image: the inner of the ``2 + 2 n`` evenly spaced cuts, from the outside in."""
    at = F.explode(F.sequence(F.lit(1), F.lit(n)))
    cut = lambda size, i: F.floor(size * i / F.lit(1.0 * (2 * n + 1))).cast("int")
    x = images.withColumn("i", at)
    return x.withColumns({"left": cut(F.col("width"), F.col("i")), "top": cut(F.col("height"), F.col("i")), "right": cut(F.col("width"), 2 * n + 1 - F.col("i")), "bottom": cut(F.col("height"), 2 * n + 1 - F.col("i"))})


def quadrants(images: DataFrame, levels: int) -> DataFrame:
    """Tiles of a pyramid: level L has ``2**L`` by ``2**L``."""
    x = images.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    side = F.pow(F.lit(2), F.col("level")).cast("int")
    x = x.withColumn("side", side).withColumn("ty", F.explode(F.sequence(F.lit(0), side - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    at = lambda size, i: F.floor(F.col(size) * i / F.col("side")).cast("int")
    return x.withColumns({"left": at("width", F.col("tx")), "top": at("height", F.col("ty")), "right": at("width", F.col("tx") + 1), "bottom": at("height", F.col("ty") + 1)}).drop("side")


def tiles(images: DataFrame, width: int, height: int, stride: tuple[int, int] | None = None, edge: bool = True) -> DataFrame:
    """Tiles of one size in steps of ``stride``; ``edge`` keeps those that end exactly on the image's edge."""
    dx, dy = stride or (width, height)
    last = lambda size, tile: F.col(size) - tile - (0 if edge else 1)
    steps = lambda size, tile, d: F.when(last(size, tile) >= 0, F.sequence(F.lit(0), last(size, tile), F.lit(d))).otherwise(F.array().cast("array<int>"))
    x = images.withColumn("top", F.explode(steps("height", height, dy))).withColumn("left", F.explode(steps("width", width, dx)))
    return x.withColumns({"right": F.col("left") + width, "bottom": F.col("top") + height})


def steps_around_one(n: int, low: float = 0.0, high: float = 2.0) -> list[float]:
    """Factors of a brightness or contrast series: ``n`` below 1, 1 itself and ``n`` above, evenly spaced on either side."""
    return [low + (1 - low) * i / n for i in range(n)] + [1.0] + [1 + (high - 1) * i / n for i in range(1, n + 1)]
