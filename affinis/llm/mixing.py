"""Mixing sources to target weights by hierarchical budgeting.

Weights are carried down a tree domain - language - source. At every node the budget is dealt to the children by weight;
a child that can't use its share gives the rest to its siblings, and only what a whole subtree can't use
goes back to the level above. Each leaf then takes the longest prefix, within its budget, of the tokens of its
documents in seeded order, epoch after epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .runtime import cut

LEVELS = ("domain", "language", "origin")
#: Columns that a selected row gets.
ADDED = ("domain", "language", "origin", "epoch", "tokens", "budget", "upto")


def _deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of the children ``name`` of each ``parent``, which has ``budget``; children have ``weight`` and ``cap``.

    Children fill up in the order of ``cap / weight``. A child is full if it and all before it, at the level it needs,
    take no more than the budget; the others share the rest by weight.
    """
    base = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = base.orderBy(F.col("cap") / F.col("weight"), name)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    x = nodes.withColumn("caps", F.sum("cap").over(upto)).withColumn("rest", F.sum("weight").over(base) - F.sum("weight").over(upto))
    x = x.withColumn("full", F.col("caps") + F.col("cap") / F.col("weight") * F.col("rest") <= F.col("budget"))
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(base), F.lit(0))
    weights = F.sum(F.when(~F.col("full"), F.col("weight"))).over(base)
    share = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("budget") - used) * F.col("weight") / weights)
    return x.withColumn("budget", F.least(F.col("cap").cast("double"), share)).drop("caps", "rest", "full")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], budget: Column) -> DataFrame:
    """``(domain, language, origin, tokens, budget)`` for ``leaves`` with ``tokens`` and ``cap``.

    ``weights[level][value]`` is a positive weight, 1 where none is given. ``budget`` is an aggregate over the leaves.
    """
    def weight(level: str) -> Column:
        given = weights.get(level) or {}
        out = F.lit(1.0)
        for value, w in given.items():
            out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
        return out

    top = leaves.agg(F.least(budget, F.sum("cap")).cast("double").alias("budget"))
    parent: list[str] = []
    for level in LEVELS:
        nodes = leaves.groupBy(*parent, level).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).withColumn("weight", weight(level))
        nodes = nodes.join(top, parent) if parent else nodes.crossJoin(F.broadcast(top))  # one row
        parent = [*parent, level]
        top = _deal(nodes, parent[:-1], level).select(*parent, "budget", "cap", "tokens")
        if level != LEVELS[-1]:
            top = top.select(*parent, "budget")
    return top.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: MD5 of seed, epoch and id as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], fraction: float = 0.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """Selected rows of ``docs`` with ``domain``, ``language``, ``origin``, ``epoch``, ``tokens``, ``budget`` and ``upto``; columns of these names are replaced.

    See ``selected``.
    """
    out = selected(docs, domain, weights, fraction, epochs, seed)
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in ADDED], *ADDED)


def selected(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], fraction: float = 0.5, epochs: int = 2, seed: int = 7) -> DataFrame:
    """Selected rows of ``docs`` as a struct ``row``, with ``domain``, ``language``, ``origin``, ``epoch``, ``tokens``, ``budget`` and ``upto``.

    The budget is ``floor(fraction * all tokens)``. A leaf can give ``epochs`` times its tokens. In order of epoch, seeded hash,
    id and text, a row is taken if the leaf's tokens up to and including it are within the leaf's budget.

    Null domain, language or source form leaves of their own, named by the empty string. Null and empty texts have no tokens
    and come along where they stand before the end of the prefix. Rows with a null id share one hash. Repeated rows are
    rows of their own. An empty table gives an empty result. Columns of any name are carried along.
    """
    named = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named(domain).alias("domain"), named(F.col("lang")).alias("language"), named(F.col("source")).alias("origin"), token_count(F.col("text")).alias("tokens"), F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    brief = leaf.drop("row")
    slim = cut(brief.groupBy(*LEVELS, "tokens", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times")))
    sums = slim.groupBy(*LEVELS).agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    leaves = cut(sums.withColumn("cap", F.col("tokens") * epochs))
    budget = cut(budgets(leaves, weights, F.floor(F.lit(fraction) * F.sum("tokens"))))

    # Sums by range of the order find where each leaf's prefix ends; only the range with the end is ranked row by row.
    times = slim.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("key", order_key(seed, F.col("epoch"), F.col("doc_id")))
    times = times.withColumn("range", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    ranges = times.groupBy(*LEVELS, "epoch", "range").agg(F.sum(F.col("tokens") * F.col("times")).alias("sum"))
    before = W.partitionBy(*LEVELS).orderBy("epoch", "range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).join(budget.select(*LEVELS, "budget"), list(LEVELS)).where("before <= budget")
    ranked = times.join(ranges, [*LEVELS, "epoch", "range"])
    step = W.partitionBy(*LEVELS, "epoch", "range").orderBy("key", "doc_id", "text_key").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranked.withColumn("each", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).withColumn("upto", F.col("before") + F.sum("tokens").over(step))
    taken = ranked.where("upto <= budget").groupBy(*LEVELS, "tokens", "doc_id", "text_key", "epoch", "budget", "times").agg(F.count(F.lit(1)).alias("copies"), F.max("upto").alias("upto"))
    return _with_rows(leaf, taken)


def _with_rows(leaf: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of ``leaf`` that were taken. Of equal rows those are meant that come first in an arbitrary order."""
    t = taken.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in LEVELS], "epoch", "budget", "upto", "copies", "times")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    for c in LEVELS:
        on = on & (F.col(c) == F.col(f"_{c}"))
    both = leaf.join(t, on)
    once = both.where("copies = times")
    some = both.where("copies < times")
    nth = W.partitionBy("_id", "_key", *[f"_{c}" for c in LEVELS], "epoch").orderBy("upto")
    some = some.withColumn("_nth", F.row_number().over(nth)).where("_nth <= copies").drop("_nth")
    return once.unionByName(some).select("row", *LEVELS, "epoch", "tokens", "budget", "upto")
