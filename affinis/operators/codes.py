"""Exact nearest hash codes of any width by multi-index hashing.

Codes are cut into pieces, each with an inverted table. Codes that differ in fewer than ``(radius + 1) * pieces`` bits agree with a query up to ``radius`` bits in at least one piece, so
probing all pieces by rising radius finds the nearest codes and proves when they are all found. Only codes that share a piece, nearly, are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis.functions import bits

from .cutting import cut

#: Bits of a word in wide codes.
WORD = 62


def piece(code: Column, wide: bool, start: int, size: int, width: int) -> Column:
    """Bits ``start`` to ``start + size`` (from the most significant) of a code of ``width`` bits, which must lie in one word."""
    if not wide:
        return F.shiftright(code, width - start - size).bitwiseAND((1 << size) - 1)
    word, at = divmod(start, WORD)
    length = min(WORD, width - word * WORD)
    return F.shiftright(F.element_at(code, word + 1), length - at - size).bitwiseAND((1 << size) - 1)


def cuts(width: int, wide: bool, size: int) -> list[tuple[int, int]]:
    """``(start, size)`` of pieces of about ``size`` bits, none across words."""
    out = []
    for word in range(0, width, WORD if wide else width):
        length = min(WORD if wide else width, width - word)
        n = max(1, round(length / size))
        ends = [round(i * length / n) for i in range(n + 1)]
        out += [(word + a, b - a) for a, b in zip(ends[:-1], ends[1:])]
    return out


def nearest_codes(codes: DataFrame, queries: DataFrame, n: int, width: int, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """``(qid, code, bits, distance)`` as ``lsh.nearest_codes``, and ``(qcode, compared)``: how many codes a code asked for was compared with.

    ``size`` is the number of bits of a piece; about the logarithm of the number of codes is best. Radii rise for all codes asked for that are not settled; of fewer codes than ``n`` all are given.
    """
    wide = dict(codes.dtypes)["code"].startswith("array")
    distinct = cut(codes.select("code").distinct())
    parts = cuts(width, wide, size)
    pieces = lambda column: F.array(*[F.struct(F.lit(i).alias("part"), piece(F.col(column), wide, a, b, width).cast("bigint").alias("piece")) for i, (a, b) in enumerate(parts)])
    postings = cut(distinct.select("code", F.inline(pieces("code"))))
    differ = (bits.wide_hamming if wide else bits.hamming)(F.col("code"), F.col("qcode"))
    asked = cut(queries.select("qcode").distinct())
    total = distinct.count()
    active, near = asked, None
    seen = None
    for radius in range(max(b for _, b in parts) + 1):
        probes = active.select("qcode", F.inline(pieces("qcode")))
        # Masks of one radius: at most 2 ** size numbers.
        masks = codes.sparkSession.range(1 << max(b for _, b in parts)).where(F.bit_count("id") == radius).select(F.col("id").alias("mask"))
        probes = probes.crossJoin(F.broadcast(masks)).select("qcode", "part", F.col("piece").bitwiseXOR(F.col("mask")).alias("piece"))
        found = postings.join(probes, ["part", "piece"]).select("qcode", "code").distinct()
        fresh = found if seen is None else found.join(seen, ["qcode", "code"], "left_anti")
        fresh = cut(fresh.withColumn("bits", differ))
        seen = fresh if seen is None else cut(seen.unionByName(fresh))
        best = seen if n >= total else seen.withColumn("k", F.row_number().over(W.partitionBy("qcode").orderBy("bits", "code"))).where(F.col("k") <= n).drop("k")
        reach = len(parts) * (radius + 1) - 1
        done = best.groupBy("qcode").agg(F.count(F.lit(1)).alias("have"), F.max("bits").alias("far")).where((F.col("have") >= min(n, total)) & (F.col("far") <= reach))
        active = cut(active.join(done.select("qcode"), "qcode", "left_anti"))
        near = best
        if active.isEmpty():
            break
    near = cut(near).select(F.col("qcode").alias("near"), "code", "bits", (F.col("bits") / F.lit(float(width))).alias("distance"))
    answer = queries.select("qid", "qcode").join(near, F.col("qcode").eqNullSafe(F.col("near"))).select("qid", "code", "bits", "distance")
    return answer, seen.groupBy("qcode").agg(F.count(F.lit(1)).alias("compared"))

