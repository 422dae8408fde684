"""Exact nearest neighbours, distance kernels and result paging.

A batch of queries is small beside the pool: it is broadcast after a check of its size, and beyond that joined in
blocks, so that pool rows stay where they are. Ranks are cut per query in every task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis.functions import vec

from . import dense

Metric = Callable[[Column, Column], Column]
#: Query rows that may be broadcast at once: 16,384 vectors of 1,000 doubles are 130 MB.
MOST_QUERIES = 16_384
#: Rows of a block of a kernel's group: a few blocks of the first size, and of up to the second where there would be more. A row is sent once for each block of its group.
BLOCK_ROWS, MOST_BLOCK_ROWS, FEW_BLOCKS = 2_048, 16_384, 8
#: Parts of a pool that is joined with more queries than may be broadcast.
POOL_PARTS = 64
#: Ids that may be broadcast.
MOST_IDS = 1_048_576


def hash_order(column: str = "uid", seed: int = 0) -> Column:
    """A random order that SQL engines share: the MD5 of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")))


class EmptyIndexError(ValueError):
    """A search needs at least one indexed row."""


def metric(name: str | Metric) -> Metric:
    return vec.METRICS[name] if isinstance(name, str) else name


def check_searchable(pool: DataFrame, query: list[float] | None) -> None:
    if query is None:
        raise ValueError("the query has no vector")
    if pool.isEmpty():
        raise EmptyIndexError("the index is empty")


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(pool: DataFrame, query: list[float], n: int, by: str | Metric = "euclidean", digits: int | None = None) -> DataFrame:
    """The ``n`` rows of ``pool (uid, vector)`` nearest to one query, with ``dist``; ties by uid."""
    dist = metric(by)(F.col("vector"), literal(query))
    return pool.select("uid", (F.round(dist, digits) if digits else dist).alias("dist")).orderBy("dist", "uid").limit(n)


def crossed(pool: DataFrame, queries: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """All pairs of pool rows and queries.

    The queries are broadcast if there are at most ``MOST_QUERIES`` (``most`` is a known bound), else dealt by ``key`` in blocks of about half that size, and the pool by its first column.
    """
    if most is not None and most <= MOST_QUERIES or queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        return pool.crossJoin(F.broadcast(queries))
    # Both sides are dealt to blocks, and each pair of blocks is one key of an equi-join.
    blocks, parts = 2 * -(-queries.count() // MOST_QUERIES), POOL_PARTS
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("_p", each(parts))
    p = pool.withColumn("_p", F.pmod(F.xxhash64(pool.columns[0]), F.lit(parts)).cast("int")).withColumn("_q", each(blocks))
    return p.join(q, ["_q", "_p"]).drop("_q", "_p")


def pairs(queries: DataFrame, pool: DataFrame, by: str | Metric = "euclidean", digits: int | None = None) -> DataFrame:
    """``(qid, uid, dist)`` of all queries and pool rows; ``queries`` has ``(qid, qvector)``."""
    name = dense.name_of(by)
    if name and (got := in_blocks(queries, pool, [name])) is not None:
        fine, odd = _parted(pool, name, got)
        return dense.pairs(queries, got, fine, {"dist": name}, digits).unionByName(_plain_pairs(queries, odd, by, digits))
    return _plain_pairs(queries, pool, by, digits)


def _plain_pairs(queries: DataFrame, pool: DataFrame, by: str | Metric, digits: int | None) -> DataFrame:
    dist = metric(by)(F.col("vector"), F.col("qvector"))
    return crossed(pool, queries, "qid").select("qid", "uid", (F.round(dist, digits) if digits else dist).alias("dist"))


def _doubles(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.simpleString() == "array<double>"


def in_blocks(queries: DataFrame, pool: DataFrame, names: list[str], extra: list[str] = ()):
    """The queries on the driver if they are at most ``MOST_QUERIES`` and blocks can take them, else null."""
    if not _doubles(queries, "qvector") or not _doubles(pool, "vector"):
        return None
    got = dense.gathered(queries, MOST_QUERIES, extra)
    return got if got is not None and dense.few(got, names) else None


def _parted(pool: DataFrame, name: str, got) -> tuple[DataFrame, DataFrame]:
    """Pool rows that blocks can take beside the queries ``got``, and the others."""
    fine = dense.regular(F.col("vector"), name, len(got["qvector"][0]))
    return pool.where(fine), pool.where(~fine)


def measured(queries: DataFrame, pool: DataFrame, names: dict[str, str], digits: int, plain: dict[str, Column]) -> DataFrame:
    """``(qid, uid, ...)`` of all queries and pool rows with several distances, by column; ``plain`` are the same as expressions, for vectors that blocks can't take."""
    slow = lambda rows: crossed(rows, queries, "qid").select("qid", "uid", *[F.round(x, digits).alias(c) for c, x in plain.items()])
    if (got := in_blocks(queries, pool, list(names.values()))) is None:
        return slow(pool)
    fine, odd = _parted(pool, "hellinger" if "hellinger" in names.values() else "hik", got)
    return dense.pairs(queries, got, fine, names, digits).unionByName(slow(odd))


def top(found: DataFrame, n: int, skip_self: bool = False) -> DataFrame:
    """The ``n`` nearest rows of each query, with ``rank`` from 1; ``n = 0`` means all. Ties by uid."""
    if skip_self:
        found = found.where(F.col("qid") != F.col("uid"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "uid")))
    return ranked.where(F.col("rank") <= n) if n else ranked


def nearest_batch(queries: DataFrame, pool: DataFrame, n: int, by: str | Metric = "euclidean", digits: int | None = None, skip_self: bool = False) -> DataFrame:
    return top(nearest_pairs(queries, pool, n, by, digits, skip_self), n, skip_self)


def nearest_pairs(queries: DataFrame, pool: DataFrame, n: int, by: str | Metric = "euclidean", digits: int | None = None, skip_self: bool = False) -> DataFrame:
    """``(qid, uid, dist)`` among which are the ``n`` nearest rows of each query: each task gives the nearest of its own rows, so that only these are shuffled to be ranked."""
    name = dense.name_of(by)
    if n and name and name != "cosine_similarity" and (got := in_blocks(queries, pool, [name])) is not None:
        fine, odd = _parted(pool, name, got)
        return dense.search(queries, got, fine, name, n, digits, skip_self).unionByName(_plain_pairs(queries, odd, by, digits))
    return pairs(queries, pool, by, digits)


def nearest_admitted(queries: DataFrame, pool: DataFrame, n: int, by: str | Metric, digits: int | None, admit) -> DataFrame | None:
    """``(qid, uid, dist, rank)``: the ``n`` nearest rows of each query among those that ``admit`` lets pass by the ``keys`` of both, arrays of ints; null if blocks can't take all of them."""
    name = dense.name_of(by)
    if not n or not name or name == "cosine_similarity" or (got := in_blocks(queries, pool, [name], ["keys"])) is None:
        return None
    fine, odd = _parted(pool, name, got)
    return top(dense.search(queries, got, fine, name, n, digits, admit=admit), n) if odd.isEmpty() else None


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, blocks)``: in how many blocks a group's rows are dealt."""
    of = lambda n: F.ceil(F.count(F.lit(1)) / n)
    return rows.groupBy(*keys).agg(F.least(of(BLOCK_ROWS), F.greatest(of(MOST_BLOCK_ROWS), F.lit(FEW_BLOCKS))).cast("int").alias("blocks"))


def _for_blocks(name: str | None, *tables: DataFrame) -> bool:
    """Whether all vectors of the tables can be taken in blocks."""
    if not name or not all(_doubles(x, "vector") for x in tables) or len({x.schema["uid"].dataType for x in tables}) > 1:
        return False
    first = tables[0].where(F.size("vector") > 0).select(F.size("vector")).first()
    return first is not None and all(x.where(~dense.regular(F.col("vector"), name, first[0])).isEmpty() for x in tables)


def matrix(a: DataFrame, b: DataFrame, by: str | Metric = "euclidean", digits: int | None = None, on: str | None = None, keep: bool = True) -> DataFrame:
    """``(row_id, col_id, dist)`` of all rows of ``a`` with all rows of ``b (uid, vector)`` that have the same ``on``, which is kept if asked for.

    Each group is dealt to pairs of blocks by its sizes on both sides, so no group is in one task.
    """
    keys = [on] if on else ["_all"]
    keep = keep and on is not None
    a, b = (x if on else x.withColumn("_all", F.lit(0)) for x in (a, b))
    sizes = _blocks(a, keys).withColumnRenamed("blocks", "blocks_a").join(_blocks(b, keys).withColumnRenamed("blocks", "blocks_b"), keys)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    if _for_blocks(name := dense.name_of(by), a, b):
        groups = sizes.agg(F.sum(F.col("blocks_a") * F.col("blocks_b"))).first()[0] or 0
        one = a.join(sizes, keys).select("uid", "vector", *keys, own("blocks_a").alias("block_a"), each("blocks_b").alias("block_b"), F.lit(0).alias("side"))
        two = b.join(sizes, keys).select("uid", "vector", *keys, each("blocks_a").alias("block_a"), own("blocks_b").alias("block_b"), F.lit(1).alias("side"))
        return dense.in_blocks(one.unionByName(two), [*keys, "block_a", "block_b"], name, digits, groups, False, keys * keep)
    one = a.join(sizes, keys).select(F.col("uid").alias("row_id"), F.col("vector").alias("a"), *keys, own("blocks_a").alias("block_a"), each("blocks_b").alias("block_b"))
    two = b.join(sizes, keys).select(F.col("uid").alias("col_id"), F.col("vector").alias("b"), *keys, each("blocks_a").alias("block_a"), own("blocks_b").alias("block_b"))
    dist = metric(by)(F.col("a"), F.col("b"))
    return one.join(two, [*keys, "block_a", "block_b"]).select("row_id", "col_id", (F.round(dist, digits) if digits else dist).alias("dist"), *[on] * keep)


def kernel(rows: DataFrame, by: str | Metric = "hik", digits: int | None = None, within: str | None = None, keep: bool = True, carried: list[str] = ()) -> DataFrame:
    """Symmetric distance kernel ``(row_id, col_id, dist)``: each unordered pair of blocks is computed once and mirrored.

    With ``within``, a column of ``rows``, there is one kernel for each of its values, which is kept if asked for; rows where it is null are in none. ``carried`` columns come along as ``row_...`` and ``col_...``.
    """
    # Rows are dealt in unordered pairs of blocks, as many as the group's size asks for, which are keys of an equi-join.
    keys = [within] if within else ["_all"]
    rows = rows if within else rows.withColumn("_all", F.lit(0))
    keep = keep and within is not None
    sizes = _blocks(rows, keys)
    sized = rows.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("uid", "vector", *keys, *carried, "own", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"))
    spot = [*keys, "block_a", "block_b"]
    if _for_blocks(name := dense.name_of(by), rows):
        groups = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
        sided = dealt.withColumn("side", F.when(F.col("block_a") == F.col("block_b"), 2).otherwise((F.col("own") == F.col("block_b")).cast("int")))
        return dense.in_blocks(sided, spot, name, digits, int(groups), True, keys * keep, list(carried))
    more = lambda which: [F.col(c).alias(f"{which}_{c}") for c in carried]
    a = dealt.where("own = block_a").select(F.col("uid").alias("row_id"), F.col("vector").alias("a"), *spot, *more("row"))
    b = dealt.where("own = block_b").select(F.col("uid").alias("col_id"), F.col("vector").alias("b"), *spot, *more("col"))
    dist = metric(by)(F.col("a"), F.col("b"))
    both = a.join(b, spot).where((F.col("block_a") < F.col("block_b")) | (F.col("row_id") <= F.col("col_id")))
    keys = [within] * keep
    sides = lambda x, y: F.struct(*[F.col(f"{p}_{c}").alias(f"{q}_{c}") for c in ("id", *carried) for p, q in ((x, "row"), (y, "col"))])
    half = both.select("row_id", "col_id", (F.round(dist, digits) if digits else dist).alias("dist"), *keys, *[f"{p}_{c}" for c in carried for p in ("row", "col")])
    twice = F.explode(F.when(F.col("row_id") == F.col("col_id"), F.array(sides("row", "col"))).otherwise(F.array(sides("row", "col"), sides("col", "row"))))
    return half.select(twice.alias("p"), "dist", *keys).select("p.row_id", "p.col_id", "dist", *keys, *[f"p.{p}_{c}" for c in carried for p in ("row", "col")])


def focus(kernel_rows: DataFrame, wanted: DataFrame, background: DataFrame) -> DataFrame:
    """Square submatrix over the background ids and the ``wanted`` ones; a wanted id counts as foreground.

    Adds ``row_background`` and ``col_background``.
    """
    flags = wanted.select("uid", F.lit(False).alias("background")).unionByName(background.select("uid", F.lit(True).alias("background"))).groupBy("uid").agg(F.min("background").alias("background"))
    rows = flags.select(F.col("uid").alias("row_id"), F.col("background").alias("row_background"))
    cols = flags.select(F.col("uid").alias("col_id"), F.col("background").alias("col_background"))
    return kernel_rows.join(rows, "row_id").join(cols, "col_id")


def focused(rows: DataFrame, wanted: DataFrame, background: DataFrame, by: str | Metric = "hik", digits: int | None = None, within: str | None = None) -> DataFrame:
    """What ``focus`` gives of the kernel of ``rows``; only the cells that it keeps are computed."""
    flags = wanted.select("uid", F.lit(False).alias("background")).unionByName(background.select("uid", F.lit(True).alias("background"))).groupBy("uid").agg(F.min("background").alias("background"))
    return kernel(rows.join(flags, "uid"), by, digits, within, keep=False, carried=["background"])


def extract_rows(kernel_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return kernel_rows.join(wanted.select(F.col("uid").alias("row_id")), "row_id", "left_semi")


def asymmetries(kernel_rows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells that differ from their mirror image, or have none."""
    mirror = kernel_rows.select(F.col("row_id").alias("col_id"), F.col("col_id").alias("row_id"), F.col("dist").alias("mirrored"))
    return kernel_rows.join(mirror, ["row_id", "col_id"], "left").where(F.col("mirrored").isNull() | (F.abs(F.col("dist") - F.col("mirrored")) > tolerance))


def page(ranked: DataFrame, first: int, last: int, order: list[Column]) -> DataFrame:
    """Rows ``first`` to ``last`` (exclusive, from 0) in ``order``."""
    return ranked.orderBy(*order).offset(first).limit(max(0, last - first))


def shuffled(rows: DataFrame, seed: int, first: int, last: int) -> DataFrame:
    """A page ``(uid, ord)`` of the uids in a seeded random order."""
    return page(rows.select("uid", hash_order(seed=seed).alias("ord")), first, last, [F.col("ord"), F.col("uid")])


def kernel_with(kernel_rows: DataFrame, rows: DataFrame, new: DataFrame, by: str | Metric = "hik", digits: int | None = None, within: str | None = None) -> DataFrame:
    """A kernel ``(row_id, col_id, dist)`` over ``rows`` with the rows and columns of ``new``: only pairs with a new row are computed.

    With ``within``, a column of both, only pairs of equal values are in the kernel.
    """
    old = matrix(new, rows, by, digits, within, keep=False)
    mirrored = old.select(F.col("col_id").alias("row_id"), F.col("row_id").alias("col_id"), "dist")
    own = kernel(new, by, digits, within, keep=False)
    return kernel_rows.select("row_id", "col_id", "dist").unionByName(old).unionByName(mirrored).unionByName(own)


def kernel_without(kernel_rows: DataFrame, uids: DataFrame) -> DataFrame:
    """The kernel without the rows and columns of ``uids``. Up to ``MOST_IDS`` ids are broadcast, so that cells stay where they are."""
    gone = uids.select("uid").distinct()
    gone = F.broadcast(gone) if gone.limit(MOST_IDS + 1).count() <= MOST_IDS else gone
    return kernel_rows.join(gone.withColumnRenamed("uid", "row_id"), "row_id", "left_anti").join(gone.withColumnRenamed("uid", "col_id"), "col_id", "left_anti")
