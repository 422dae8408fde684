"""Keyed collections as tables: ordered multi-get, upsert, removal, adjudication and set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class MissingKeyError(KeyError):
    """Keys that a collection doesn't have."""


def _missing(wanted: DataFrame, have: DataFrame, key: str) -> list:
    return [r[0] for r in wanted.join(have, key, "left_anti").select(key).distinct().limit(10).collect()]


def ordered_get(collection: DataFrame, wanted: DataFrame, key: str = "uid", strict: bool = True) -> DataFrame:
    """Rows for ``wanted (pos, key)``, which may repeat keys, with ``pos``.

    ``strict`` fails on a key that isn't there; otherwise its other columns are null.
    """
    if strict and (gone := _missing(wanted, collection, key)):
        raise MissingKeyError(gone)
    return wanted.join(collection, key, "left")


def upsert(collection: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``collection`` with ``new`` rows, which replace those of the same key."""
    return collection.join(new, key, "left_anti").unionByName(new)


def remove(collection: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """``collection`` without ``keys``; fails, and removes none, if one isn't there."""
    if gone := _missing(keys, collection, key):
        raise MissingKeyError(gone)
    return collection.join(keys, key, "left_anti")


def get(collection: DataFrame, keys: DataFrame, key: str = "key", default=None) -> DataFrame:
    """Values by key; a missing one gets ``default`` or, without any, fails."""
    if default is None:
        if gone := _missing(keys, collection, key):
            raise MissingKeyError(gone)
        return keys.join(collection, key)
    return keys.join(collection, key, "left").withColumn("value", F.coalesce("value", F.lit(default)))


def not_computed(inputs: DataFrame, computed: DataFrame, key: str = "uid", overwrite: bool = False) -> DataFrame:
    """Rows that still need computing: all of them on ``overwrite``."""
    return inputs if overwrite else inputs.join(computed, key, "left_anti")


def unhashed(inputs: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows whose uid is in no bucket ``(code, uids)``."""
    return inputs.join(buckets.select(F.explode("uids").alias("uid")), "uid", "left_anti")


def unique_vs_total(rows: DataFrame, key: str = "uid") -> DataFrame:
    """``(total, distinct_uids)`` of ``rows``."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("distinct_uids"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b).unionByName(b.subtract(a))


def disjoint_union(a: DataFrame, b: DataFrame, id_column: str = "id") -> DataFrame:
    """Union of two id spaces; if they overlap, ``b``'s ids are moved beyond ``a``'s greatest."""
    overlap = not a.join(b, id_column, "left_semi").isEmpty()
    shift = a.agg(F.max(id_column)).first()[0] if overlap else 0
    return a.unionByName(b.withColumn(id_column, (F.col(id_column) + shift).cast(dict(a.dtypes)[id_column])))


def final_adjudication(log: DataFrame) -> DataFrame:
    """``(sid, uid, role)`` after a log ``(sid, batch, uid, action)`` of ``pos``, ``neg``, ``un_pos`` and ``un_neg``.

    A batch adds to a side and removes from the other. A uid that a batch names for both ends in neither; taking back what isn't there does
    nothing. For one uid this depends on its last batches only, so it is a fold over its actions in order.
    """
    per_batch = log.groupBy("sid", "uid", "batch").agg(*[F.max((F.col("action") == a).cast("int")).alias(a) for a in ("pos", "neg", "un_pos", "un_neg")])
    steps = per_batch.groupBy("sid", "uid").agg(F.sort_array(F.collect_list(F.struct("batch", "pos", "neg", "un_pos", "un_neg"))).alias("steps"))
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))

    def step(acc, s):
        p = (F.greatest(acc["p"], s["pos"]) == 1) & (s["un_pos"] == 0) & (s["neg"] == 0)
        n = (F.greatest(acc["n"], s["neg"]) == 1) & (s["un_neg"] == 0) & (s["pos"] == 0)
        return F.struct(p.cast("int").alias("p"), n.cast("int").alias("n"))

    state = steps.withColumn("s", F.aggregate("steps", start, step))
    return state.select("sid", "uid", F.when(F.col("s.p") == 1, "pos").when(F.col("s.n") == 1, "neg").alias("role")).where(F.col("role").isNotNull())
