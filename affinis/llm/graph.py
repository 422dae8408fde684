"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .runtime import cut


def hub_join(rows: DataFrame, one: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``one``, which has a row for each value of ``keys``.

    The join is by a hash of the keys: what an aggregate has dealt out by the keys themselves is dealt out again, and so adaptive
    skew joins can split the many ``rows`` of one key.
    """
    mixed = F.xxhash64(*keys, F.lit("hub"))
    named = one.withColumn("_k", mixed).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.withColumn("_k", mixed).join(named, "_k").where(same).drop("_k", *[f"_{k}" for k in keys])


def _roots(edges: DataFrame, most: int) -> DataFrame:
    """``(id, label)``: every id points to its least neighbour, itself included, and pointers are doubled until they lead to an id that points to itself."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("v")))
    low = cut(both.groupBy("id").agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("label")))
    for _ in range(most):
        one = low.select(F.col("id").alias("label"), F.col("label").alias("next"))
        step = cut(hub_join(low, one, "label").select("id", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
        if step.where("moved").isEmpty():
            return low
        low = step.drop("moved")
    raise RuntimeError(f"pointers did not settle in {most} rounds")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every id that an edge ``(a, b)`` touches, component = smallest reachable id.

    Loops, repeated edges and nulls are ignored. A round takes the trees of least neighbours together to their roots and goes on with the
    edges between different roots; every id that isn't the least of its neighbours goes, so stars end in one round. Rounds grow with the logarithm of
    the number of ids, joins in a round with the logarithm of the longest descending chain. A hub's edges are split by adaptive skew joins.
    Raises if ``max_rounds`` isn't enough.
    """
    found = None
    left = cut(_normal(edges))
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        roots = _roots(left, max_rounds)
        if found is None:
            found = roots
        else:
            later = roots.select(F.col("id").alias("label"), F.col("label").alias("root"))
            found = found.join(later, "label", "left").select("id", F.coalesce("root", "label").alias("label"))
        left = cut(_normal(relabelled(left, roots)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return found.select("id", F.col("label").alias("component"))


def _normal(edges: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` between the labels of their ends; ``labels`` has ``(id, label)`` for every end."""
    for end in ("a", "b"):
        edges = hub_join(edges, labels.select(F.col("id").alias(end), F.col("label").alias(f"to_{end}")), end)
    return edges.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
