"""Ball index over hash codes: exact nearest codes that look only into balls that can hold them.

Codes belong to the nearest of a few centres; a ball has its centre, radius and number of codes. By the triangle inequality a code in
a ball is at least ``distance to the centre - radius`` and at most ``distance + radius`` away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis.functions import bits

from . import knn
from .cutting import cut

#: Codes of a leaf and balls that a ball is split into, in a tree.
LEAF, SPLIT = 32, 8


def _hamming(rows: DataFrame, column: str, a: Column, b: Column) -> Column:
    return (bits.wide_hamming if dict(rows.dtypes)[column].startswith("array") else bits.hamming)(a, b)


def build(codes: DataFrame, balls: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(code, ball)`` of the distinct codes and ``(ball, centre, radius, n)`` for at most ``balls`` balls, whose centres are drawn by hash."""
    distinct = codes.select("code").distinct()
    centres = distinct.orderBy(F.xxhash64("code"), "code").limit(balls).select(F.col("code").alias("centre")).withColumn("ball", F.xxhash64("centre"))
    away = _hamming(distinct, "code", F.col("code"), F.col("centre"))
    home = distinct.crossJoin(F.broadcast(centres)).groupBy("code").agg(F.min(F.struct(away.alias("away"), F.col("ball"), F.col("centre"))).alias("h"))
    members = home.select("code", F.col("h.ball").alias("ball"), F.col("h.away").alias("away"), F.col("h.centre").alias("centre"))
    shapes = members.groupBy("ball").agg(F.first("centre").alias("centre"), F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
    return members.select("code", "ball"), shapes


def nearest_codes(members: DataFrame, shapes: DataFrame, queries: DataFrame, n: int, width: int) -> DataFrame:
    """``(qid, code, bits, distance)``: as ``lsh.nearest_codes``, for ``queries (qid, qcode)``.

    For a query, the balls nearest by their farthest point that hold ``n`` codes together bound the distance of the ``n``-th code; balls whose nearest
    point is beyond it are not looked into.
    """
    asked = queries.select("qcode").distinct()
    away = _hamming(shapes, "centre", F.col("centre"), F.col("qcode"))
    far = knn.crossed(asked, shapes, "ball").withColumn("away", away)  # balls are few
    order = W.partitionBy("qcode").orderBy(F.col("away") + F.col("radius"), "ball").rowsBetween(W.unboundedPreceding, 0)
    held = far.withColumn("held", F.sum("n").over(order))
    bound = F.min(F.when(F.col("held") >= n, F.col("away") + F.col("radius"))).over(W.partitionBy("qcode"))
    visited = held.withColumn("bound", bound).where(F.col("bound").isNull() | (F.col("away") - F.col("radius") <= F.col("bound"))).select("qcode", "ball")
    found = members.join(visited, "ball").withColumn("bits", _hamming(members, "code", F.col("code"), F.col("qcode")))
    near = found.withColumn("rank", F.row_number().over(W.partitionBy("qcode").orderBy("bits", "code"))).where(F.col("rank") <= n)
    near = near.select(F.col("qcode").alias("near"), "code", "bits", (F.col("bits") / F.lit(float(width))).alias("distance"))
    return queries.select("qid", "qcode").join(near, F.col("qcode").eqNullSafe(F.col("near"))).select("qid", "code", "bits", "distance")


def tree(codes: DataFrame, leaf: int = LEAF, split: int = SPLIT, most_levels: int = 32) -> tuple[DataFrame, int]:
    """``(level, parent, ball, centre, radius, n, last, code)``: a tree of balls over the distinct codes, all balls of a level split at once, and its depth.

    A ball of more than ``leaf`` codes is split by the nearest of ``split`` of its codes, drawn by hash. Rows of a ``last`` ball, which is not split, are its codes; a split ball has one row, without a code.
    """
    open_ = cut(codes.select("code").distinct().withColumn("ball", F.lit(0).cast("bigint")))
    levels = []
    away = _hamming(open_, "code", F.col("code"), F.col("centre"))
    for level in range(most_levels):
        rank = F.row_number().over(W.partitionBy("ball").orderBy(F.xxhash64("code", F.lit(level)), "code"))
        centres = open_.withColumn("k", rank).where(F.col("k") <= split).groupBy("ball").agg(F.collect_list("code").alias("centres"))
        near = F.array_min(F.transform("centres", lambda c: F.struct(_hamming(open_, "code", F.col("code"), c).alias("d"), c.alias("c"))))["c"]
        homes = open_.join(centres, "ball").select("code", F.col("ball").alias("parent"), near.alias("centre")).withColumn("ball", F.xxhash64("parent", "centre", F.lit(level)))
        homes = cut(homes.withColumn("away", away))
        shapes = homes.groupBy("parent", "ball").agg(F.first("centre").alias("centre"), F.max("away").alias("radius"), F.count(F.lit(1)).alias("n"))
        shapes = cut(shapes.withColumn("last", F.col("n") <= leaf))
        ends = homes.join(shapes.drop("centre"), ["parent", "ball"]).where("last")
        columns = [F.lit(level).alias("level"), "parent", "ball", "centre", "radius", "n", "last"]
        levels.append(shapes.where("not last").select(*columns, F.lit(None).cast(dict(codes.dtypes)["code"]).alias("code")).unionByName(ends.select(*columns, "code")))
        open_ = cut(homes.join(shapes.where("not last").select("ball"), "ball").select("code", "ball"))
        if open_.isEmpty():
            break
    nodes = levels[0]
    for more in levels[1:]:
        nodes = nodes.unionByName(more)
    return cut(nodes), len(levels)


def nearest_in_tree(codes: DataFrame, nodes: DataFrame, depth: int, queries: DataFrame, n: int, width: int) -> DataFrame:
    """``(qid, code, bits, distance)`` as ``nearest_codes``, by a tree of balls.

    Level by level, the balls that a code asked for still follows bound its ``n``-th code by their farthest points; those whose nearest point is beyond go.
    """
    asked = cut(queries.select("qcode").distinct())
    away = _hamming(codes, "code", F.col("centre"), F.col("qcode"))
    shapes = lambda level: nodes.where(F.col("level") == level).select("parent", "ball", "centre", "radius", "n", "last").dropDuplicates(["parent", "ball"])
    here = None
    for level in range(depth):
        new = shapes(level)
        # Below the root there are few balls.
        below = asked.crossJoin(F.broadcast(new)) if here is None else here.where("not last").select("qcode", F.col("ball").alias("parent")).join(new, "parent")
        below = below.withColumn("away", away).select("qcode", "ball", "radius", "n", "last", "away")
        below = below if here is None else here.where("last").unionByName(below)
        order = W.partitionBy("qcode").orderBy(F.col("away") + F.col("radius"), "ball").rowsBetween(W.unboundedPreceding, 0)
        bound = F.min(F.when(F.col("held") >= n, F.col("away") + F.col("radius"))).over(W.partitionBy("qcode"))
        below = below.withColumn("held", F.sum("n").over(order)).withColumn("bound", bound)
        here = cut(below.where(F.col("bound").isNull() | (F.col("away") - F.col("radius") <= F.col("bound"))).select("qcode", "ball", "radius", "n", "last", "away"))
    found = nodes.where("last").select("ball", "code").join(here.select("qcode", "ball"), "ball").withColumn("bits", _hamming(codes, "code", F.col("code"), F.col("qcode")))
    near = found.withColumn("rank", F.row_number().over(W.partitionBy("qcode").orderBy("bits", "code"))).where(F.col("rank") <= n)
    near = near.select(F.col("qcode").alias("near"), "code", "bits", (F.col("bits") / F.lit(float(width))).alias("distance"))
    return queries.select("qid", "qcode").join(near, F.col("qcode").eqNullSafe(F.col("near"))).select("qid", "code", "bits", "distance")
