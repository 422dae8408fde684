"""Inverted cells: k-means centroids, nearest cells of a query, exact ranking within them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from affinis.functions import vec

from . import knn


def fit_cells(rows: DataFrame, cells: int, seed: int = 0, sample: int = 50_000) -> list[list[float]]:
    """Centroids from a bounded sample; all rows are indexed by ``assign``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    total = rows.count()
    drawn = rows.where(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < min(1.0, sample / max(1, total)))
    model = KMeans(k=min(cells, max(1, total)), seed=seed, maxIter=15).fit(drawn.select(array_to_vector("vector").alias("features")))
    return [list(map(float, c)) for c in model.clusterCenters()]


def _order(vector, centroids: list[list[float]]):
    """Centroid numbers by distance from a vector."""
    table = F.array(*[F.struct(F.lit(i).alias("cell"), knn.literal(c).alias("c")) for i, c in enumerate(centroids)])
    return F.transform(F.array_sort(F.transform(table, lambda t: F.struct(vec.squared_euclidean(vector, t["c"]).alias("d"), t["cell"].alias("cell")))), lambda t: t["cell"])


#: Centroids up to which their distances are expressions; more are compared as a matrix, in Arrow batches.
MOST_LITERALS = 64


def nearest_cells(rows: DataFrame, column: str, centroids: list[list[float]], n: int = 1) -> DataFrame:
    """``rows`` with ``cells``, the numbers of the ``n`` nearest centroids of ``column``."""
    if len(centroids) <= MOST_LITERALS:
        return rows.withColumn("cells", F.slice(_order(F.col(column), centroids), 1, n))
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centroids, np.float64))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        c = shared.value
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return rows.withColumn("cells", nearest(column))


def assign(rows: DataFrame, centroids: list[list[float]]) -> DataFrame:
    return nearest_cells(rows, "vector", centroids).withColumn("cell", F.col("cells")[0]).drop("cells")


def _probed(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    table = np.zeros((max(rows.max(), query.max()) + 1, len(query)), bool)
    table[query.ravel(), np.repeat(np.arange(len(query)), query.shape[1])] = True
    return table[rows[:, 0]]


def in_blocks(indexed: DataFrame, queries: DataFrame, n: int, by, digits: int | None) -> DataFrame | None:
    """``search`` for queries with their ``cells``, in blocks of rows and queries, if these can be taken: no pair is shuffled."""
    rows = indexed.withColumn("keys", F.array(F.col("cell").cast("int")))
    return knn.nearest_admitted(queries.withColumn("keys", F.transform("cells", lambda c: c.cast("int"))), rows, n, by, digits, _probed)


def search(indexed: DataFrame, queries: DataFrame, centroids: list[list[float]], n: int, probes: int = 1, by="euclidean", digits: int | None = None) -> DataFrame:
    """``(qid, uid, dist, rank)`` from the ``probes`` nearest cells; fewer than ``n`` if those hold fewer.

    ``indexed`` is ``(uid, vector, cell)``; stored partitioned by ``cell``, only the probed partitions are read.
    """
    near = nearest_cells(queries, "qvector", centroids, probes)
    if (found := in_blocks(indexed, near, n, by, digits)) is not None:
        return found
    asked = near.withColumn("cell", F.explode("cells")).drop("cells")
    dist = knn.metric(by)(F.col("vector"), F.col("qvector"))
    found = indexed.join(asked, "cell").select("qid", "uid", (F.round(dist, digits) if digits else dist).alias("dist"))
    return knn.top(found, n)


def principal_axes(rows: DataFrame, width: int) -> list[list[float]]:
    """Axes of the greatest variance, for the reduction before an index."""
    from .hashing import _partial_sums

    d = rows.select(F.size("vector")).first()[0]
    first = _partial_sums(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]), d + 1)
    mean = first[1:] / first[0]
    values, vectors = np.linalg.eigh(_partial_sums(rows, lambda x: (x - mean).T @ (x - mean), d * d).reshape(d, d))
    return vectors[:, np.argsort(values)[::-1][:width]].T.tolist()


def reduced(rows: DataFrame, axes: list[list[float]], column: str = "vector") -> DataFrame:
    table = F.array(*[knn.literal(a) for a in axes])
    return rows.withColumn(column, F.transform(F.array(F.col(column)), lambda v: F.transform(table, lambda a: vec.dot(v, a)))[0])


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    hits = exact.join(found, ["qid", "uid"], "left_semi").count()
    return hits / max(1, exact.count())


