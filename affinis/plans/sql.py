"""The engine's expressions as SQL functions of a session: scalars, and lists of rows for ``LATERAL VIEW inline`` or ``explode``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession, functions as F

from affinis.operators.dense import matrix_of

#: Rows whose numbers are summed at once, one dimension after the other.
ROWS = 512


def _sum(x: np.ndarray, y: np.ndarray, step) -> np.ndarray:
    out = np.zeros(x.shape[1])
    for u, v in zip(x, y, strict=True):
        out += step(u, v)
    return out


def _euclidean(x, y):
    return np.sqrt(_sum(x, y, lambda u, v: (u - v) * (u - v)))


def _likeness(x, y):
    norms = np.sqrt(_sum(x, x, np.multiply)) * np.sqrt(_sum(y, y, np.multiply))
    return np.ma.masked_array(_sum(x, y, np.multiply) / np.where(norms == 0, 1, norms), norms == 0)


def _angle(x, y):
    # Where there is no likeness, the least and the greatest pass over it: the distance is that of opposites.
    return 2 * np.arccos(np.fmin(1.0, np.maximum(-1.0, _likeness(x, y).filled(-1.0)))) / np.pi


def _overlap(x, y):
    return 1 - _sum(x, y, np.fmin)


#: Functions of columns of vectors, by dimension; sums go over the dimensions in their order, as SQL's do.
VECTORS = {"euclidean_distance": _euclidean, "cosine_likeness": _likeness, "angular_distance": _angle, "intersection_distance": _overlap}


def _single(name: str, a: list | None, b: list | None) -> float | None:
    """A pair with a null or of different widths: what a vector lacks is null, which only the least of two numbers passes over."""
    none = 2.0 if name == "angular_distance" else None
    if a is None or b is None:
        return none
    pairs = [(a[i] if i < len(a) else None, b[i] if i < len(b) else None) for i in range(max(len(a), len(b)))]
    if name == "intersection_distance":
        pairs = [(y if x is None else x, x if y is None else y) for x, y in pairs]
    if any(x is None or y is None for x, y in pairs):
        return none
    x, y = (np.array([p[i] for p in pairs], np.float64).reshape(-1, 1) for i in (0, 1))
    return np.ma.masked_array(VECTORS[name](x, y)).tolist()[0]


def _vectorised(name: str):
    """An Arrow function of two columns of vectors."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        widths = [pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False) for c in (a, b)]
        width = int(widths[0].max()) if len(a) else 0
        fine = (widths[0] == width) & (widths[1] == width) & (width > 0)
        for c in (a, b):
            if pc.list_flatten(c).null_count:
                fine &= np.array([v is not None and None not in v for v in c.to_pylist()], bool)
        if fine.all() and len(a):
            x, y, parts = matrix_of(a), matrix_of(b), []
            with np.errstate(all="ignore"):
                for k in range(0, len(x), ROWS):
                    found = np.ma.masked_array(VECTORS[name](*(np.ascontiguousarray(v[k : k + ROWS].T) for v in (x, y))))
                    parts.append(pa.array(found.data, pa.float64(), mask=np.ma.getmaskarray(found)))
            return pa.concat_arrays(parts)
        out = [None] * len(a)
        some = np.flatnonzero(fine)
        for i, d in zip(some, run(a.take(pa.array(some)), b.take(pa.array(some))).to_pylist() if len(some) else [], strict=True):
            out[i] = d
        for i in np.flatnonzero(~fine):
            out[i] = _single(name, a[int(i)].as_py(), b[int(i)].as_py())
        return pa.array(out, pa.float64())

    return F.arrow_udf(run, "double")


#: Bodies by signature.
SCALARS = {
    "hamming_distance(p BIGINT, q BIGINT) RETURNS INT": "bit_count(p ^ q)",
}
LISTS = {
    "crop_tiles(width INT, height INT, w INT, h INT) RETURNS ARRAY<STRUCT<`left`: INT, top: INT, `right`: INT, bottom: INT>>": (
        "flatten(transform(filter(sequence(0, greatest(width - w, 0), w), x -> x + w <= width), x -> transform(filter(sequence(0, greatest(height - h, 0), h), y -> y + h <= height), y -> struct(x AS `left`, y AS top, x + w AS `right`, y + h AS bottom))))"
    ),
    "nearby_codes(code BIGINT, bits INT) RETURNS ARRAY<BIGINT>": "transform(sequence(0, bits - 1), i -> code ^ shiftleft(1L, i))",
}


def register(spark: SparkSession) -> list[str]:
    """Defines all functions for the session; gives their names."""
    for name in VECTORS:
        spark.udf.register(name, _vectorised(name))
    for signature, body in (SCALARS | LISTS).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [*VECTORS, *[s.split("(")[0] for s in SCALARS | LISTS]]
