"""Hash index: buckets of codes, nearest codes, and exact ranking of their members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from affinis.functions import bits

from . import dense, knn
from .cutting import cut

#: Rows of nearest codes that may be broadcast: three numbers each.
MOST_NEAR = 1_048_576


def buckets(coded: DataFrame) -> DataFrame:
    """``(code, uids)`` of ``(uid, code)`` rows, uids sorted; the stored form is the flat one, this is for look-ups by code."""
    return coded.groupBy("code").agg(F.sort_array(F.collect_set("uid")).alias("uids"))


def count(coded: DataFrame) -> DataFrame:
    """How many ids the codes hold, each once a code."""
    return coded.select("code", "uid").distinct().agg(F.count(F.lit(1)).alias("n"))


def nearest_codes(codes: DataFrame, queries: DataFrame, n: int, width: int) -> DataFrame:
    """``(qid, code, bits, distance)``: for each query ``(qid, qcode)`` the ``n`` nearest distinct codes.

    ``distance`` is the share of bits that differ; ties by code. Codes are ranked once for each distinct code asked for,
    of which there are at most ``2 ** width``, and then given to all queries of that code. Codes of more than 62 bits are arrays of words.
    """
    wide = dict(codes.dtypes)["code"].startswith("array")
    if wide and (near := _wide_codes(codes.select("code").distinct(), queries, n, width)) is not None:
        return near
    differ = (bits.wide_hamming if wide else bits.hamming)(F.col("code"), F.col("qcode"))
    found = knn.crossed(codes.select("code").distinct(), queries.select("qcode").distinct(), "qcode", 2**width).select("qcode", "code", differ.alias("bits"))
    rank = F.row_number().over(W.partitionBy("qcode").orderBy("bits", "code"))
    near = found.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("qcode").alias("near"), "code", "bits", (F.col("bits") / F.lit(float(width))).alias("distance"))
    if 2**width * min(n, 2**width) <= MOST_NEAR:
        near = F.broadcast(near)
    return queries.select("qid", "qcode").join(near, F.col("qcode").eqNullSafe(F.col("near"))).select("qid", "code", "bits", "distance")


#: Codes that are compared with all queries at once.
CODES = 2_048


def _differences(codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """In how many bits the words of codes differ from those of codes asked for."""
    out = np.zeros((len(codes), len(asked)), np.int16)
    for c, q in zip(codes.T, asked.T, strict=True):
        out += np.bitwise_count(c[:, None] ^ q)
    return out


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _wide_codes(codes: DataFrame, queries: DataFrame, n: int, width: int) -> DataFrame | None:
    """``nearest_codes`` of codes of several words, in blocks; null with more codes asked for than may be broadcast, or null ones.

    First it is counted how many codes differ in how many bits from each code asked for, which tells how far its ``n`` nearest are; then only codes as near as that are ranked.
    """
    asked = queries.select("qcode").distinct().limit(knn.MOST_QUERIES + 1).toArrow()["qcode"].combine_chunks()
    length, codes = -(-width // 62), cut(codes)
    if not 0 < len(asked) <= knn.MOST_QUERIES or asked.null_count or not codes.where(F.col("code").isNull() | (F.size("code") != length)).isEmpty():
        return None
    asked = asked if isinstance(asked, pa.Array) else asked.chunk(0)
    shared = codes.sparkSession.sparkContext.broadcast(_words(asked))
    dealt = dense.dealt(codes, codes.count() * len(asked), True)

    def counted(batches):
        q = shared.value
        found = np.zeros((len(q), width + 1), np.int64)
        for batch in batches:
            for k in range(0, len(batch), CODES):
                away = _differences(_words(batch.column(0).slice(k, CODES)), q)
                at = (away + np.arange(len(q)) * (width + 1)).ravel()
                found += np.bincount(at, minlength=found.size).reshape(found.shape)
        i, b = np.nonzero(found)
        for k in range(0, len(i), dense.BATCH):
            part = slice(k, k + dense.BATCH)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i[part].astype(np.int32)), "b": pa.array(b[part].astype(np.int32)), "n": pa.array(found[i[part], b[part]])})

    counts = np.zeros((len(asked), width + 1), np.int64)
    totals = dealt.mapInArrow(counted, "i int, b int, n bigint").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()
    counts[totals["i"].to_numpy(), totals["b"].to_numpy()] = totals["n"].to_numpy()
    upto = counts.cumsum(axis=1)
    most = np.where(upto[:, -1] >= n, (upto >= n).argmax(axis=1), width)
    schema = StructType([StructField("i", IntegerType()), codes.schema["code"], StructField("bits", IntegerType())])
    out = dense.arrow_schema(schema)

    def picked(batches):
        q = shared.value
        for batch in batches:
            for k in range(0, len(batch), CODES):
                part = batch.column(0).slice(k, CODES)
                away = _differences(_words(part), q)
                c, i = np.nonzero(away <= most)
                yield from dense.emitted(out, [pa.array(i.astype(np.int32)), part.take(pa.array(c)), pa.array(away[c, i].astype(np.int32))])

    rank = F.row_number().over(W.partitionBy("i").orderBy("bits", "code"))
    near = dealt.mapInArrow(picked, schema).withColumn("rank", rank).where(F.col("rank") <= n).select("i", "code", "bits", (F.col("bits") / F.lit(float(width))).alias("distance"))
    numbers = codes.sparkSession.createDataFrame([(x, i) for i, x in enumerate(asked.to_pylist())], StructType([StructField("qcode", codes.schema["code"].dataType), StructField("i", IntegerType())]))
    known = queries.select("qid", "qcode").join(F.broadcast(numbers), "qcode")
    return near.join(F.broadcast(known), "i").select("qid", "code", "bits", "distance")


def allowed(codes: DataFrame, queries: DataFrame, n: int, width: int) -> np.ndarray | None:
    """Whether a code is among the ``n`` nearest of a code asked for, by both; null for codes of so many bits that the table would be large."""
    if 2**width * min(n, 2**width) > MOST_NEAR or dict(codes.dtypes)["code"].startswith("array"):
        return None
    asked = queries.where(F.col("qcode").isNotNull()).select(F.col("qcode").alias("qid"), "qcode").distinct()
    out = np.zeros((1 << width, 1 << width), bool)
    for r in nearest_codes(codes.where(F.col("code").isNotNull()), asked, n, width).select("qid", "code").collect():
        out[r["code"], r["qid"]] = True
    return out


def in_blocks(coded: DataFrame, queries: DataFrame, n: int, by, digits: int | None, allowed: np.ndarray) -> DataFrame | None:
    """``search`` with the pairs of codes that are ``allowed``, in blocks of rows and queries, if these can be taken: no pair is shuffled."""
    fits = lambda rows, query: allowed[rows[:, 0]][:, query[:, 0]]
    keyed = lambda df, code: df.withColumn("keys", F.array(F.col(code).cast("int")))
    return knn.nearest_admitted(keyed(queries, "qcode"), keyed(coded, "code"), n, by, digits, fits)


def _members(coded: DataFrame, queries: DataFrame, near: DataFrame, by, digits: int | None) -> DataFrame | None:
    """``(qid, uid, dist)`` of the members of near codes; the queries' vectors are not shuffled. Null if blocks can't take all vectors, or ids of queries repeat."""
    name = dense.name_of(by)
    if not name or (got := knn.in_blocks(queries, coded, [name])) is None or len(got["qid"].unique()) < len(got):
        return None
    fine, odd = knn._parted(coded.select("uid", "vector", "code"), name, got)
    if not odd.isEmpty():
        return None
    return dense.listed(fine.join(near.select("qid", "code"), "code").select("qid", "uid", "vector"), got, name, digits)


def search(coded: DataFrame, queries: DataFrame, n: int, width: int, by="cosine", n_codes: int | None = None, digits: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """``(qid, uid, dist, rank)``: members of each query's ``n`` nearest codes, ranked exactly.

    ``coded`` is ``(uid, vector, code)``, ``queries`` ``(qid, qvector, qcode)``. As in the classic index, ``n`` counts codes as
    well as results; ``n_codes`` sets the number of codes apart. ``near`` are nearest codes found another way.
    """
    if near is None and (table := allowed(coded.select("code"), queries, n_codes or n, width)) is not None and (found := in_blocks(coded, queries, n, by, digits, table)) is not None:
        return found
    near = nearest_codes(coded, queries, n_codes or n, width) if near is None else near
    if (found := _members(coded, queries, near, by, digits)) is not None:
        return knn.top(found, n)
    asked = near.select("qid", "code").join(queries.select("qid", "qvector"), "qid")
    dist = knn.metric(by)(F.col("vector"), F.col("qvector"))
    found = coded.join(asked, "code").select("qid", "uid", (F.round(dist, digits) if digits else dist).alias("dist"))
    return knn.top(found, n)


def update(coded: DataFrame, new: DataFrame) -> DataFrame:
    """Index with ``new`` rows; a uid that was there loses its old code."""
    return coded.join(new, "uid", "left_anti").unionByName(new)


def remove(coded: DataFrame, uids: DataFrame) -> DataFrame:
    from .sets import remove as removed

    return removed(coded, uids, "uid")
