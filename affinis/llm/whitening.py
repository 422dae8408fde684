"""Whitening of vectors by streamed moments.

Tasks take vectors one by one: Welford's update moves the mean and adds one rank-one matrix to the scatter, so that large offsets cancel
before anything is multiplied. Tasks' states are merged by the parallel formula, in rounds of a few states each, and the symmetric QR algorithm
gives the components. A state has ``d * d`` numbers; at most ``FAN`` for each width of vectors come to the driver.

Vectors are integers (``quantised``), so sums and deviations are exact. Vectors that are null or hold null or non-finite entries are dropped; vectors of different widths are
fitted apart, and empty ones have no components. Repeated rows weigh once in the fit and are each returned. A direction without variance has no whitened value (null); where all variance is 0, ``explained`` and ``identity_error`` are null.
Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .runtime import cut

#: Entries are held within so many units of either side of 0, where doubles are exact integers.
MOST = 1 << 52
#: States that one task, or the driver at last, merges.
FAN = 32


def quantised(rows: DataFrame, column: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``rows`` with ``x``, the entries as ``floor(scale * c) + offset``, without rows that have no such vector. Entries beyond ``MOST`` count as ``MOST``."""

    def entry(c: Column) -> Column:
        return (F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(MOST // 2))), F.lit(float(-MOST // 2)))) + offset).cast("bigint")

    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return rows.where(F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn("x", F.transform(column, entry))


class Moments:
    """Number, mean and scatter of vectors; means are kept from the first vector on, which is exact for integers."""

    def __init__(self, pivot: np.ndarray):
        self.n, self.pivot = 0, pivot.astype(np.float64)
        self.mean, self.scatter = np.zeros(len(pivot)), np.zeros((len(pivot), len(pivot)))

    def add(self, x: np.ndarray) -> None:
        """Welford's step: a rank-one update of the scatter."""
        self.n += 1
        before = x - self.pivot - self.mean
        self.mean += before / self.n
        self.scatter += np.outer(before, before * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> None:
        """The parallel update: scatters add up, and the means' difference gives one more rank-one matrix."""
        apart = (other.pivot - self.pivot) + (other.mean - self.mean)
        n = self.n + other.n
        self.scatter += other.scatter + np.outer(apart, apart * (self.n * other.n / n))
        self.mean += apart * (other.n / n)
        self.n = n


STATE = "width int, n bigint, pivot binary, mean binary, scatter binary, high binary, low binary"
_SHIFT = 20


def _written(states: dict[int, tuple[Moments, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    rows = [(d, m.n, m.pivot.tobytes(), m.mean.tobytes(), m.scatter.tobytes(), high.tobytes(), low.tobytes()) for d, (m, high, low) in sorted(states.items())]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["width", "n", "pivot", "mean", "scatter", "high", "low"])


def _read(row: dict) -> tuple[Moments, np.ndarray, np.ndarray]:
    m = Moments(np.frombuffer(row["pivot"]))
    m.n, m.mean = row["n"], np.frombuffer(row["mean"]).copy()
    m.scatter = np.frombuffer(row["scatter"]).reshape(row["width"], row["width"]).copy()
    return m, np.frombuffer(row["high"], np.int64).copy(), np.frombuffer(row["low"], np.int64).copy()


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column and their matrix, for each width but 0."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(widths):
        if d:
            at = np.flatnonzero(widths == d)
            yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, tuple[Moments, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for _, x in by_width(batch.column(0)):
            d = x.shape[1]
            if d not in states:
                states[d] = Moments(x[0]), np.zeros(d, np.int64), np.zeros(d, np.int64)
            moments, high, low = states[d]
            for row in x.astype(np.float64):
                moments.add(row)
            if x.dtype.kind == "i":
                high += (x >> _SHIFT).sum(0)
                low += (x & ((1 << _SHIFT) - 1)).sum(0)
    if states:
        yield _written(states)


def _take(states: dict[int, tuple[Moments, np.ndarray, np.ndarray]], row: dict) -> None:
    """Merge a written state into those at hand."""
    new = _read(row)
    if row["width"] not in states:
        states[row["width"]] = new
        return
    moments, high, low = states[row["width"]]
    moments.merge(new[0])
    high += new[1]
    low += new[2]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    states: dict[int, tuple[Moments, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            _take(states, row)
    if states:
        yield _written(states)


def moments(vectors: DataFrame) -> dict[int, tuple[Moments, list[int]]]:
    """Moments and exact integer sums, by width, of the one column of ``vectors``."""
    states = cut(vectors.mapInArrow(_gathered, STATE))
    left, before = states.count(), math.inf
    while FAN < left < before:
        states = cut(states.repartition(-(-left // FAN)).mapInArrow(_merged, STATE))
        left, before = states.count(), left
    out: dict[int, tuple[Moments, np.ndarray, np.ndarray]] = {}
    for row in states.orderBy("width").toLocalIterator():
        _take(out, row.asDict())
    return {d: (found, [(int(a) << _SHIFT) + int(b) for a, b in zip(high, low, strict=True)]) for d, (found, high, low) in out.items()}


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: Householder reflections to three diagonals, then implicit QR steps with Wilkinson's shift."""
    a = np.array(matrix, np.float64)
    d = len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, :] -= 2 * np.outer(x, x @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    main, off = np.diag(a).tolist(), np.diag(a, -1).tolist()
    turns = q.T.copy()  # rows are the vectors
    eps, high = np.finfo(float).eps, d - 1
    for _ in range(100 * d + 100):
        while high > 0 and abs(off[high - 1]) <= eps * (abs(main[high - 1]) + abs(main[high])):
            off[high - 1] = 0.0
            high -= 1
        if high <= 0:
            break
        low = high - 1
        while low > 0 and abs(off[low - 1]) > eps * (abs(main[low - 1]) + abs(main[low])):
            low -= 1
        half = (main[high - 1] - main[high]) / 2
        b = off[high - 1]
        shift = main[high] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = main[low] - shift, off[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                off[k - 1] = r
            p, o, n = main[k], off[k], main[k + 1]
            main[k] = c * c * p + 2 * c * s * o + s * s * n
            main[k + 1] = s * s * p - 2 * c * s * o + c * c * n
            off[k] = c * s * (n - p) + (c * c - s * s) * o
            if k + 1 < high:
                x, z = off[k], s * off[k + 1]
                off[k + 1] *= c
            pair = turns[k].copy()
            turns[k] = c * pair + s * turns[k + 1]
            turns[k + 1] = c * turns[k + 1] - s * pair
    else:
        raise RuntimeError("eigenvalues did not settle")
    order = np.argsort(-np.array(main), kind="stable")
    return np.array(main)[order], turns[order].T


@dataclass
class Whitening:
    """The fit of one width: exact sums of ``n`` integer vectors, eigenvalues, falling, and as many components as are wanted."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def used(self) -> np.ndarray:
        """Components with variance beyond rounding."""
        return self.values[: self.axes.shape[1]] > np.finfo(float).eps * len(self.values) * max(self.trace, 0.0)

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened values and exact deviations (null beyond 64 bits) of integer vectors."""
        sums = self.sums
        reach = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, sums))
        if reach * reach * len(sums) < 1 << 62:
            away = x * self.n - np.array(sums, np.int64)
            deviations = (away * away).sum(1).tolist()
        else:
            away = x.astype(object) * self.n - np.array(sums, object)
            deviations = [v if v < 1 << 63 else None for v in (away * away).sum(1)]
        root = np.sqrt(np.where(self.used, self.values[: self.axes.shape[1]], np.inf))
        return away.astype(np.float64) / self.n @ self.axes / root, deviations


def fit(vectors: DataFrame, components: int = 16) -> dict[int, Whitening]:
    """Whitenings by width of ``vectors``, one column of distinct integer arrays, which is read twice: for its moments and for the whitened vectors' own."""
    models = {}
    for d, (found, sums) in moments(vectors).items():
        values, axes = symmetric_qr(found.scatter / found.n)
        values = np.maximum(values, 0)
        models[d] = Whitening(found.n, sums, values, axes[:, :components], float(values.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in by_width(batch.column(0)):
                # The width goes along as a last entry, which does not vary: whitened vectors of different widths may be as long.
                w = np.concatenate([models[x.shape[1]].scaled(x)[0], np.full((len(x), x.shape[1]), 0.0)], 1)
                yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.list_(pa.float64()))], ["w"])

    if models:
        checked = moments(vectors.mapInArrow(run, "w array<double>"))
        for d, model in models.items():
            k = model.axes.shape[1]
            used = model.used
            found = checked[k + d][0]
            if used.any():
                model.identity_error = float(np.abs((found.scatter[:k, :k] / found.n)[np.ix_(used, used)] - np.eye(int(used.sum()))).max())
    return models


def apply(rows: DataFrame, key: str, models: dict[int, Whitening]) -> DataFrame:
    """A row for each component of each of ``rows`` with a vector ``x``: ``key``, component, n, deviation, whitened, explained, identity_error."""
    plain = rows.select(key, "x")
    kind = plain.schema[key]
    out = StructType([kind]).add(StructType.fromDDL("m array<struct<component: int, n: bigint, deviation: bigint, whitened: double, explained: double, identity_error: double>>").fields[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_width(batch.column(1)):
                model = models[x.shape[1]]
                white, deviations = model.scaled(x)
                k, used = model.axes.shape[1], model.used
                fields = {
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(k * len(x), model.n, np.int64)),
                    "deviation": pa.array(deviations, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    "whitened": pa.array(white.ravel(), mask=np.tile(~used, len(x))),
                    "explained": pa.array(np.tile(model.values[:k] / (model.trace or 1.0), len(x)), mask=np.full(k * len(x), model.trace == 0)),
                    "identity_error": pa.array([model.identity_error] * (k * len(x)), pa.float64()),
                }
                flat = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], [key, "m"])

    return plain.mapInArrow(run, out).select(key, F.inline("m"))


def whiten(rows: DataFrame, key: str, column: str, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Whitened components of every vector, fitted on each distinct vector once."""
    held = quantised(rows, column, scale, offset).select(key, "x")
    return apply(held, key, fit(cut(held.select("x").distinct()), components))
