"""Random-projection trees: recursive median splits, leaves shared by neighbours, exact ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from affinis.functions import vec

from . import dense, knn

#: Sketches give the medians of nodes of up to so many rows; of larger ones they give two values that are so near in rank, between which the median is looked up.
ACCURACY = 10_000


def bases(dimensions: int, trees: int, depth: int, seed: int | None = 0) -> list[list[list[float]]]:
    """A direction for each level of each tree; 0 is a seed like others, None draws a new one."""
    return np.random.default_rng(seed).standard_normal((trees, depth, dimensions)).tolist()


def _projected(rows: DataFrame, column: str, directions: list[list[list[float]]], keep: list[str]) -> DataFrame:
    """``keep`` with a row for each tree: ``ps``, the vector along the tree's direction of each level. Vectors don't go along."""
    table = F.array(*[F.array(*[knn.literal(d) for d in tree]) for tree in directions])
    along = F.transform(F.array(F.col(column)), lambda v: F.transform(table, lambda tree: F.transform(tree, lambda d: vec.dot(v, d))))[0]
    return rows.select(*keep, F.posexplode(along).alias("tree", "ps"))


def build(rows: DataFrame, directions: list[list[list[float]]]) -> tuple[DataFrame, dict[tuple[int, int], float]]:
    """``(uid, tree, leaf)`` and the split values by ``(tree, node)``.

    All trees grow together. Per level one aggregate gives the nodes' medians, exactly, by sketches of bounded size, ``2 ** depth`` values a tree come to the
    driver, and each row goes left where its value is below its node's, as queries do. Rows of equal values stay together.
    """
    if knn._for_blocks("euclidean", rows.select("uid", "vector")):
        along = _along(rows, "uid", "vector", directions).withColumnRenamed("along", "ps").select("uid", F.posexplode("ps").alias("tree", "ps"))
    else:
        along = _projected(rows, "vector", directions, ["uid"])
    out = along.withColumn("node", F.lit(1))
    splits: dict[tuple[int, int], float] = {}
    for level in range(len(directions[0])):
        p = F.col("ps")[level]
        new = medians(out.select("tree", "node", p.alias("p")))
        splits |= new
        out = out.withColumn("node", _child(new, len(directions), level, p))
    return out.select("uid", "tree", F.col("node").alias("leaf")), splits


def medians(rows: DataFrame) -> dict[tuple[int, int], float]:
    """The lower median of ``p`` by ``(tree, node)``, exactly."""
    share = 3 / ACCURACY
    sketch = F.percentile_approx("p", F.array(*[F.lit(x) for x in (0.5, 0.5 - share, 0.5 + share)]), ACCURACY)
    found = rows.groupBy("tree", "node").agg(sketch.alias("m"), F.count("p").alias("n")).collect()
    out = {(r["tree"], r["node"]): r["m"] and r["m"][0] for r in found}
    large = [(r["tree"], r["node"], r["m"][1], r["m"][2], (r["n"] + 1) // 2) for r in found if r["n"] > ACCURACY]
    if large:
        bounds = F.broadcast(rows.sparkSession.createDataFrame(large, "tree int, node int, low double, high double, k bigint"))
        # How many lie below, and how often each value between occurs: equal values are one row.
        there = rows.join(bounds, ["tree", "node"]).where(F.col("p") <= F.col("high"))
        counts = there.groupBy("tree", "node", "k", F.when(F.col("p") >= F.col("low"), F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(W.partitionBy("tree", "node").orderBy(F.col("p").asc_nulls_first()))
        least = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & F.col("p").isNotNull()).groupBy("tree", "node").agg(F.min("p").alias("m"))
        out |= {(r["tree"], r["node"]): r["m"] for r in least.collect()}
    return out


def _child(splits: dict[tuple[int, int], float], trees: int, level: int, p: Column) -> Column:
    """The child of a row's ``node`` on ``level`` of its ``tree``: values by place in an array."""
    width = 1 << level
    values = F.array(*[F.lit(splits.get((t, width + i))).cast("double") for t in range(trees) for i in range(width)])
    split = F.element_at(values, F.col("tree") * width + F.col("node") - width + 1)
    return F.col("node") * 2 + F.when(p < split, 0).otherwise(1)


def leaves(queries: DataFrame, directions: list[list[list[float]]], splits: dict[tuple[int, int], float]) -> DataFrame:
    """``(qid, tree, leaf)``: a query goes left where its value is below the split."""
    out = _projected(queries, "qvector", directions, ["qid"]).withColumn("node", F.lit(1))
    for level in range(len(directions[0])):
        out = out.withColumn("node", _child(splits, len(directions), level, F.col("ps")[level]))
    return out.select("qid", "tree", F.col("node").alias("leaf"))


def _sums(x: np.ndarray, directions) -> np.ndarray:
    """Vectors along all directions, by row, tree and level; sums go over the dimensions in their order, as those of expressions."""
    ways, columns = np.array(directions), np.ascontiguousarray(x.T)
    out = np.zeros((ways.shape[0], ways.shape[1], len(x)))
    for k, column in enumerate(columns):
        out += ways[:, :, k, None] * column
    return out.transpose(2, 0, 1)


def _along(rows: DataFrame, key: str, column: str, directions) -> DataFrame:
    """``(key, along)``: sums by tree and level."""
    schema = StructType([rows.schema[key], StructField("along", ArrayType(ArrayType(DoubleType())))])
    out = dense.arrow_schema(schema)

    def run(batches):
        for batch in batches:
            if len(batch):
                found = _sums(dense.matrix_of(batch.column(1)), directions)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[list(t) for t in row] for row in found.tolist()], out.field("along").type)], schema=out)

    return rows.select(key, column).mapInArrow(run, schema)


def placed(rows: DataFrame, key: str, column: str, directions, splits: dict[tuple[int, int], float]) -> DataFrame:
    """``(key, column, keys)``: the leaf of a vector in each tree."""
    schema = StructType([rows.schema[key], rows.schema[column], StructField("keys", ArrayType(IntegerType()))])
    out, depth = dense.arrow_schema(schema), len(directions[0])
    values = np.full((len(directions), 1 << depth), -np.inf)
    for (tree, node), split in splits.items():
        if split is not None:
            values[tree, node] = split

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            found = _sums(dense.matrix_of(batch.column(1)), directions)
            node, tree = np.ones(found.shape[:2], np.int32), np.arange(len(directions))
            for level in range(depth):
                node = node * 2 + (found[:, :, level] >= values[tree, node])
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(0, node.size + 1, node.shape[1], dtype=np.int32)), pa.array(node.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), leaves.cast(out.field("keys").type)], schema=out)

    return rows.select(key, column).mapInArrow(run, schema)


def _share(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Whether a row and a query are in the same leaf of a tree."""
    found = np.zeros((len(rows), len(query)), bool)
    for r, q in zip(rows.T, query.T, strict=True):
        found |= r[:, None] == q
    return found


def axes(rows: DataFrame, trees: int, depth: int, seed: int = 0, among: int = 40) -> list[list[list[float]]]:
    """Directions of kd-trees: at each level one of the ``among`` dimensions of the greatest variance, by chance."""
    spread = rows.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v")).orderBy(F.col("v").desc(), "i").collect()
    rng, width = np.random.default_rng(seed), len(spread)
    widest = [r["i"] for r in spread[: max(among, depth)]]
    return [[np.eye(width)[i].tolist() for i in rng.permutation(widest)[:depth]] for _ in range(trees)]


def search(rows: DataFrame, built: DataFrame, queries: DataFrame, directions, splits, n: int, squared: bool = True, digits: int | None = None) -> DataFrame:
    """``(qid, uid, dist, rank)`` from the union of the queries' leaves, by squared Euclidean distance.

    A task compares the leaves of its rows with those of the queries, so that no hits are shuffled. With vectors that blocks can't take, hits are pairs of ids, each once, before the vectors of ``rows`` join.
    """
    if knn._doubles(queries, "qvector") and queries.where(~dense.regular(F.col("qvector"), "euclidean", len(directions[0][0]))).isEmpty() and knn._for_blocks("euclidean", rows.select("uid", "vector")):
        asked = placed(queries, "qid", "qvector", directions, splits)
        found = knn.nearest_admitted(asked, placed(rows, "uid", "vector", directions, splits), n, "squared_euclidean" if squared else "euclidean", digits, _share)
        if found is not None:
            return found
    hits = built.join(leaves(queries, directions, splits), ["tree", "leaf"]).select("qid", "uid").distinct()
    dist = (vec.squared_euclidean if squared else vec.euclidean)(F.col("vector"), F.col("qvector"))
    found = rows.join(hits.join(queries.select("qid", "qvector"), "qid"), "uid")
    return knn.top(found.select("qid", "uid", (F.round(dist, digits) if digits else dist).alias("dist")), n)
