"""Binomials, primes, factors and intervals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: 97.5 % quantile of the normal distribution, for 95 % intervals.
Z95 = 1.959963984540054


def binomial(n: Column, r: Column) -> Column:
    """Number of ways to choose ``r`` of ``n``; 0 where that is impossible."""
    k = F.least(r, n - r)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.when((r < 0) | (r > n), F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, i: (acc * (n - k + i) / i).cast("bigint")))


def is_prime(n: Column) -> Column:
    divisors = F.when(n >= 4, F.sequence(F.lit(2).cast("bigint"), F.floor(F.sqrt(n)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return (n >= 2) & ~F.exists(divisors, lambda d: n % d == 0)


def factor_pairs(n: Column) -> Column:
    """Pairs ``(a, b)`` with ``1 <= a <= b`` and ``a * b = n``; none below 1."""
    small = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.floor(F.sqrt(n)).cast("bigint"), F.lit(1).cast("bigint"))), lambda d: (n % d == 0) & (d <= n))
    return F.transform(small, lambda d: F.struct(d.alias("a"), (n / d).cast("bigint").alias("b")))


def prime_factors(n: Column) -> Column:
    """Prime factors with multiplicity, ascending: those up to the root, and what is left of ``n`` without them."""
    n = n.cast("bigint")
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    primes = F.filter(F.sequence(two, F.greatest(F.floor(F.sqrt(n)).cast("bigint"), two)), lambda d: (n % d == 0) & is_prime(d))
    powers = F.flatten(F.transform(primes, lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.lit(62)), lambda e: F.when((F.pow(p.cast("double"), e) <= n) & (n % F.pow(p.cast("double"), e).cast("bigint") == 0), p)), lambda x: x.isNotNull())))
    left = lambda found: F.aggregate(found, n, lambda m, p: F.floor(m / p).cast("bigint"))
    return F.transform(F.array(powers), lambda found: F.when(left(found) > one, F.array_append(found, left(found))).otherwise(found))[0]


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a proportion."""
    trials, z2 = F.nullif(trials, F.lit(0)), z * z
    p = successes / trials
    middle = (p + z2 / (2 * trials)) / (1 + z2 / trials)
    reach = z * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials)) / (1 + z2 / trials)
    return middle - reach, middle + reach
