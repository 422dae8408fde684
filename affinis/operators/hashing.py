"""Sign-projection hash codes: seeded random projections and iterative quantization."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from affinis.functions import bits, vec


@dataclass
class Projection:
    """Code of a vector: signs of its normalised, centred form times ``matrix`` (dimensions by bits)."""

    matrix: list[list[float]]
    mean: list[float] | None = None
    order: float | str | None = None
    #: Whether to subtract the mean before the norm is taken, or after.
    mean_first: bool = False
    losses: list[float] = field(default_factory=list)

    @property
    def width(self) -> int:
        return len(self.matrix[0])

    def bits(self, vector: Column) -> Column:
        arr = lambda values: F.array(*[F.lit(float(v)) for v in values])
        x = vector
        if self.mean_first and self.mean is not None:
            x = vec.centred(x, arr(self.mean), self.order or 2) if self.order is not None else F.zip_with(x, arr(self.mean), lambda a, m: a - m)
        else:
            x = vec.normalized(x, self.order) if self.order is not None else x
            x = F.zip_with(x, arr(self.mean), lambda a, m: a - m) if self.mean is not None else x
        columns = F.array(*[arr(c) for c in zip(*self.matrix, strict=True)])
        return F.transform(F.array(x), lambda v: F.transform(columns, lambda c: (vec.dot(v, c) >= 0).cast("int")))[0]

    def code(self, vector: Column) -> Column:
        """A number for up to 62 bits, else an array of words."""
        b = self.bits(vector)
        return bits.to_int(b) if self.width <= 62 else bits.to_words(b)


def with_codes(rows: DataFrame, projection: Projection) -> DataFrame:
    return rows.withColumn("code", projection.code(F.col("vector")))


def random_projection(dimensions: int, width: int, seed: int = 0, mean: list[float] | None = None, order: float | str | None = None) -> Projection:
    matrix = np.random.default_rng(seed).standard_normal((dimensions, width))
    return Projection(matrix.tolist(), mean, order, mean_first=True)


def sign_matrix(dimensions: int, width: int) -> list[list[int]]:
    """A fixed matrix of 1 and -1: the parity of the bits that row and column number share, mixed with their product."""
    return [[1 - 2 * (((i * 7 + 3) * (j * 5 + 1) >> 2 ^ bin(i & (j + 1)).count("1")) & 1) for j in range(width)] for i in range(dimensions)]


def mean_vector(rows: DataFrame) -> DataFrame:
    """``(pos, mean)`` by dimension."""
    return rows.select(F.posexplode("vector").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def covariance(rows: DataFrame) -> DataFrame:
    """``(i, j, cov)`` for ``i <= j``, with ``n - 1`` in the denominator.

    Two passes of the tasks' partial sums, of means and of centred products; only these, ``d * d`` numbers, come to the driver.
    """
    first = rows.where(F.col("vector").isNotNull()).select(F.size("vector")).first()
    if first is None:
        return rows.sparkSession.createDataFrame([], "i int, j int, cov double")
    d = first[0]
    sums = _partial_sums(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]), d + 1)
    n, mean = sums[0], sums[1:] / sums[0]
    scatter = _partial_sums(rows, lambda x: (x - mean).T @ (x - mean), d * d).reshape(d, d)
    return rows.sparkSession.createDataFrame([(i, j, float(scatter[i, j] / (n - 1)) if n > 1 else None) for i in range(d) for j in range(i, d)], "i int, j int, cov double")


def _partial_sums(rows: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all tasks of ``function(matrix of a batch)``, arrays of ``size`` numbers."""

    def run(batches):
        import pyarrow as pa

        acc = np.zeros(size)
        for batch in batches:
            column = batch.column(0)
            if len(column):
                acc += function(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([acc.tolist()], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select("vector").where(F.col("vector").isNotNull()).mapInArrow(run, "sums array<double>")
    total = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r["x"] for r in total]) if total else np.zeros(size)


def fit_itq(rows: DataFrame, width: int = 8, iterations: int = 50, order: float | str | None = None, seed: int = 0) -> Projection:
    """Iterative quantization over all rows.

    Mean and covariance come from one pass each; every iteration gathers one ``width`` by ``width`` matrix from the tasks. Only these small matrices
    and their decompositions are on the driver.
    """
    d = rows.where(F.col("vector").isNotNull()).select(F.size("vector")).first()[0]
    if width > d:
        raise ValueError("more bits than dimensions")

    def shaped(x: np.ndarray) -> np.ndarray:
        if order is None:
            return x
        n = np.linalg.norm(x, np.inf if order == "inf" else order, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    first = _partial_sums(rows, lambda x: np.concatenate([[len(x)], shaped(x).sum(0)]), d + 1)
    n, mean = first[0], first[1:] / first[0]
    scatter = _partial_sums(rows, lambda x: (shaped(x) - mean).T @ (shaped(x) - mean), d * d).reshape(d, d)
    values, vectors = np.linalg.eigh(scatter / max(n - 1, 1))
    axes = vectors[:, np.argsort(values)[::-1][:width]]
    rotation = np.linalg.svd(np.random.default_rng(seed).standard_normal((width, width)))[0]
    losses = []
    for _ in range(iterations):
        turn = rotation

        def step(x: np.ndarray, turn: np.ndarray = turn) -> np.ndarray:
            v = (shaped(x) - mean) @ axes
            z = v @ turn
            b = np.where(z >= 0, 1.0, -1.0)
            return np.concatenate([(b.T @ v).ravel(), [((b - z) ** 2).sum()]])

        sums = _partial_sums(rows, step, width * width + 1)
        losses.append(float(sums[-1]))
        u, _, w = np.linalg.svd(sums[:-1].reshape(width, width))
        rotation = w.T @ u.T
        if len(losses) > 1 and losses[-2] - losses[-1] <= 1e-9 * max(losses[-1], 1e-12):
            break
    return Projection((axes @ rotation).tolist(), mean.tolist(), order, losses=losses)
