import random
from math import comb, pi, sqrt

import pytest
from pyspark.sql import functions as F

from affinis.functions import bits, geometry, numbers, text, vec
from affinis.operators.knn import literal


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("a,b,dist", [([0, 0], [0, 0], 1), ([0, 0], [1, 0], 1), ([1, 0], [0, 1], 1), ([1, 0], [0.5, 0.5], 0.5), ([0.5, 0.5], [0.5, 0.5], 0), ([1, 0], [1, 0], 0)])
def test_histogram_intersection(spark, a, b, dist):
    assert one(spark, vec.hik(literal(a), literal(b))) == dist
    assert one(spark, vec.hik(literal(b), literal(a))) == dist


def test_distances(spark):
    a, b = literal([1, 0]), literal([0, 1])
    assert one(spark, vec.euclidean(a, b)) == pytest.approx(sqrt(2))
    assert one(spark, vec.cosine(a, b)) == 0
    assert one(spark, vec.angular(vec.cosine(a, b))) == pytest.approx(1)
    assert one(spark, vec.angular(F.lit(1.0000000000000002))) == 0
    assert one(spark, vec.angular(F.lit(-1.0))) == pytest.approx(2)
    assert one(spark, vec.angular(F.lit(-1.0), positive=False)) == pytest.approx(1)
    assert one(spark, vec.normalized(literal([0, 0]), 2)) == [0, 0]
    assert one(spark, vec.centred(literal([2, 2]), literal([2, 2]))) == [0, 0]
    assert one(spark, vec.norm(literal([3, -4]), 1), vec.norm(literal([3, -4]), "inf"), vec.norm(literal([3, -4]), 3)) == pytest.approx((7, 4, 91 ** (1 / 3)))
    assert one(spark, F.acos(F.lit(0.0))) == pytest.approx(pi / 2)


def test_hamming_and_counts(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(1 << 40), rng.randrange(1 << 40)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", bits.hamming(F.col("a"), F.col("b")).alias("d"), bits.popcount(F.col("a")).alias("n")).collect()
    assert all(r["d"] == bin(r["a"] ^ r["b"]).count("1") and r["n"] == bin(r["a"]).count("1") for r in rows)
    assert one(spark, bits.wide_hamming(F.array(F.lit(1), F.lit(7)), F.array(F.lit(0), F.lit(1)))) == 3


def test_bits(spark):
    assert one(spark, bits.from_int(F.lit(5), 4), bits.to_int(F.array(F.lit(1), F.lit(0), F.lit(1)))) == ([0, 1, 0, 1], 5)
    with pytest.raises(Exception, match="bits are needed"):
        one(spark, bits.from_int(F.lit(5), 1))
    assert bits.masks(4, 0) == [0] and bits.masks(4, -1) == [] and bits.masks(3, 4) == []
    assert len(bits.masks(8, 3)) == comb(8, 3)
    words = one(spark, bits.to_words(F.array(*[F.lit(1)] * 64)))
    assert words == [2**62 - 1, 3]


def test_probabilities(spark):
    p = literal([0.2, 0.3, 0.5])
    assert one(spark, vec.checked_adjustment(p, literal([1, 1, 1]))) == pytest.approx([0.2, 0.3, 0.5])
    twice = vec.adjusted(vec.adjusted(p, literal([1, 2, 3])), literal([2, 0, -2]))
    assert one(spark, twice) == pytest.approx(one(spark, vec.adjusted(p, literal([3, 2, 1]))))
    up = one(spark, vec.adjusted(p, literal([0, 1, 0])))
    assert up[1] > 0.3 and up[0] < 0.2 and up[2] < 0.5
    for bad in ([-0.1, 0.5, 0.6], [0, 0, 0], [0.5, 0.5]):
        with pytest.raises(Exception, match="probabilities must be"):
            one(spark, vec.checked_adjustment(literal(bad), literal([0, 0, 0])))


def test_boxes(spark):
    a, b, c, d = literal([0, 0]), literal([2, 2]), literal([1, 1]), literal([3, 4])
    both = one(spark, geometry.intersection(a, b, c, d))
    assert (both["low"], both["high"]) == ([1, 1], [2, 2])
    assert one(spark, geometry.intersection(a, c, c, d)) is None
    assert one(spark, geometry.hypervolume(c, d), geometry.valid(a, b), geometry.valid(b, a), geometry.near(a, literal([0, 1e-9]))) == (6, True, False, True)
    assert one(spark, geometry.crop_fits(F.lit(0), F.lit(0), F.lit(5), F.lit(5), F.lit(5), F.lit(5))) is True
    assert one(spark, geometry.crop_fits(F.lit(0), F.lit(0), F.lit(0), F.lit(5), F.lit(5), F.lit(5))) is False


def test_grids(spark):
    image = spark.createDataFrame([(1, 10, 6)], "uid int, width int, height int")
    assert geometry.tiles(image, 5, 3).count() == 4
    assert geometry.tiles(image, 5, 3, edge=False).count() == 1
    assert geometry.quadrants(image, 2).count() == 1 + 4 + 16
    assert [tuple(r) for r in geometry.centre_crops(image, 2).orderBy("i").select("left", "right").collect()] == [(2, 8), (4, 6)]
    assert geometry.steps_around_one(2) == [0.0, 0.5, 1.0, 1.5, 2.0]


def test_strings(spark):
    assert one(spark, text.partition(F.lit("abcdefgh"), 3)) == ["abc", "def", "gh"]
    with pytest.raises(Exception, match="more parts"):
        one(spark, text.partition(F.lit("ab"), 3))
    join = lambda *s: one(spark, text.url_join(*map(F.lit, s)))
    assert join("http://a", "b", "c") == "http://a/b/c"
    assert join("http://a/", "/b") == "/b"
    assert join("x", "http://a", "b/", "") == "http://a/b/"
    assert join("http://", "a") == "http://a"
    assert join("", "a", "", "b") == "a/b"
    assert one(spark, text.content_type(F.lit("x/y.PNG")), text.content_type(F.lit("noext"))) == ("image/png", None)
    assert one(spark, text.from_base64_url(F.lit("-_-_"))) == bytes([251, 255, 191])
    assert one(spark, text.source_of(F.lit("file:///a")), text.source_of(F.lit("https://a")), text.source_of(F.lit("nothing"))) == ("file", "url", None)


def test_numbers(spark):
    n = lambda c: one(spark, c)
    assert [n(numbers.binomial(F.lit(5), F.lit(r))) for r in (-1, 0, 2, 5, 6)] == [0, 1, 10, 1, 0]
    assert [i for i in range(1, 30) if n(numbers.is_prime(F.lit(i)))] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29]
    assert n(numbers.prime_factors(F.lit(360))) == [2, 2, 2, 3, 3, 5]
    assert [tuple(p) for p in n(numbers.factor_pairs(F.lit(12)))] == [(1, 12), (2, 6), (3, 4)]
    low, high = (n(c) for c in numbers.wilson(F.lit(8), F.lit(10)))
    assert low == pytest.approx(0.490162, abs=1e-6) and high == pytest.approx(0.943318, abs=1e-6)
