"""Vector expressions over ``array<double>`` columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def rounded(x: Column, digits: int = 6) -> Column:
    """Halves of the number times a power of ten go away from zero, as in SQL; ``F.round`` takes the shortest decimal of the number, which may be a half where that product is not."""
    scaled = x * F.lit(float(10**digits))
    whole = F.floor(F.abs(scaled)).cast("double")
    return F.signum(scaled) * (whole + F.when(F.abs(scaled) - whole >= 0.5, 1.0).otherwise(0.0)) / F.lit(float(10**digits)) + F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column, order: float | str = 2) -> Column:
    """L-p norm; ``"inf"`` is the greatest absolute value."""
    if order == "inf":
        return F.array_max(F.transform(a, lambda x: F.abs(x)))
    if order == 2:
        return F.sqrt(total(F.transform(a, lambda x: x * x)))
    if order == 1:
        return total(F.transform(a, lambda x: F.abs(x)))
    return F.pow(total(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(order))))), F.lit(1.0 / order))


def normalized(a: Column, order: float | str = 2) -> Column:
    """``a`` over its norm; a zero vector stays as it is."""
    return F.transform(F.array(norm(a, order)), lambda n: F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))[0]


def centred(a: Column, mean: Column, order: float | str = 2) -> Column:
    """``a - mean`` over its norm; where that is not a number, 0."""
    return F.transform(normalized(F.zip_with(a, mean, lambda x, m: x - m), order), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def angular(similarity: Column, positive: bool = True) -> Column:
    """Angular distance of a cosine similarity, clamped to [-1, 1]; ``positive`` vectors have at most a right angle."""
    return F.lit(2.0 if positive else 1.0) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), similarity))) / F.pi()


def intersection(a: Column, b: Column) -> Column:
    """Histogram intersection, a similarity."""
    return total(F.zip_with(a, b, lambda x, y: F.least(x, y)))


def hik(a: Column, b: Column) -> Column:
    """Histogram intersection distance: 1 less the intersection; a zero vector is at distance 1 of all."""
    return F.lit(1.0) - intersection(a, b)


def histogram(a: Column) -> Column:
    """Absolute values over their sum."""
    return normalized(F.transform(a, lambda x: F.abs(x)), 1)


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, order: float) -> Column:
    """Sum of ``abs(x - y) ** order``, without the root."""
    return total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(order)))))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def hellinger(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x) - F.sqrt(y), F.lit(2.0))))


def chi_square(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(F.lit(0.0))))


def kullback_leibler(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), x * F.log(x / y)).otherwise(F.lit(0.0))))


METRICS = {"euclidean": euclidean, "cosine": lambda a, b: angular(cosine(a, b)), "hik": hik, "chi_square": chi_square, "squared_euclidean": squared_euclidean, "manhattan": manhattan, "hellinger": hellinger}


def adjusted(p: Column, adjustment: Column) -> Column:
    """Class probabilities moved by ``exp(adjustment - max(adjustment))`` and normalised again."""
    moved = F.zip_with(p, adjustment, lambda x, a: x * F.exp(a - F.array_max(adjustment)))
    return F.transform(F.array(total(moved)), lambda s: F.transform(moved, lambda x: F.try_divide(x, s)))[0]


def checked_adjustment(p: Column, adjustment: Column) -> Column:
    """``adjusted``, which fails on negative or all-zero probabilities and on different widths."""
    fine = (F.size(p) == F.size(adjustment)) & (F.array_min(p) >= 0) & (F.array_max(p) > 0)
    return F.when(fine, adjusted(p, adjustment)).otherwise(F.raise_error(F.lit("probabilities must be of the adjustment's width, not negative and not all zero")))
