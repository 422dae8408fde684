"""Near-duplicate vectors through an inverted multi-index.

Each half of a unit vector has a codebook of its own; the product of both codebooks is a grid of
cells. A vector lies in the cell of its two nearest centroids and visits cells in multi-sequence order,
by rising lower bound of the distance that a vector there can have. The traversal ends where that bound
exceeds the distance of the similarity threshold, so that the target recall of 1 is reached by
construction; every candidate is then verified in double precision. Of two cells only the lower one's vectors visit the other.
The codebooks grow with the square root of the number of vectors. Vectors are moved to the rows of the grid that they visit, once for each
row and block there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components, hub_join
from .runtime import cut, drawn

#: Rows of which the codebooks are fitted; all rows are indexed.
SAMPLE = 8192
#: Vectors of a cell, about, and most entries of a codebook.
CELL, MOST = 64, 512
#: Vectors of a task's block, on either side.
BLOCK = 1024


def k_means(rows: np.ndarray, k: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on a small sample; fewer rows than ``k`` are their own centroids."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= k:
        return rows
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = ((rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        n = np.bincount(near, minlength=k)[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def _bounds(half: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and the row's distance to the half space that each centroid wins from it."""
    d2 = np.maximum((half**2).sum(1)[:, None] - 2 * half @ centres.T + (centres**2).sum(1), 0)
    home = d2.argmin(1)
    apart = np.sqrt(np.maximum(((centres[:, None] - centres[None]) ** 2).sum(2), 1e-300))
    low = (d2 - d2[np.arange(len(half)), home][:, None]) / (2 * apart[home])
    low[np.arange(len(half)), home] = 0
    return home, np.maximum(low, 0)


def multi_sequence(low_a: np.ndarray, low_b: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells ``(i, j)`` in order of ``low_a[i]**2 + low_b[j]**2``, as long as that is within ``limit``."""
    a, b = np.argsort(low_a, kind="stable"), np.argsort(low_b, kind="stable")
    cost = lambda p, q: low_a[a[p]] ** 2 + low_b[b[q]] ** 2
    heap, out = [(cost(0, 0), 0, 0)], []
    while heap:
        c, p, q = heapq.heappop(heap)
        if c > limit:
            break
        out.append((int(a[p]), int(b[q])))
        if q + 1 < len(b):
            heapq.heappush(heap, (cost(p, q + 1), p, q + 1))
        if q == 0 and p + 1 < len(a):
            heapq.heappush(heap, (cost(p + 1, 0), p + 1, 0))
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _place(codebooks, limit: float, vector: pa.DataType):
    """Each vector's own cell ``(a, b)``, and for each row of the grid from ``a`` on the columns that it visits there."""
    visit = pa.list_(pa.struct([("i", pa.int32()), ("js", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                x = _matrix(part.column(3))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                half = int(width) // 2
                first, second = codebooks.get(int(width)) or (np.zeros((1, half)), np.zeros((1, int(width) - half)))
                (home_a, low_a), (home_b, low_b) = _bounds(x[:, :half], first), _bounds(x[:, half:], second)
                visits = []
                for own, p, q in zip(zip(home_a.tolist(), home_b.tolist(), strict=True), low_a, low_b, strict=True):
                    rows: dict[int, list[int]] = {}
                    for i, j in multi_sequence(p, q, limit):
                        if (i, j) >= own:
                            rows.setdefault(i, []).append(j)
                    visits.append([{"i": i, "js": js} for i, js in rows.items()])
                yield pa.RecordBatch.from_arrays([*part.columns[:3], part.column(3).cast(vector), pa.array(home_a, pa.int32()), pa.array(home_b, pa.int32()), pa.array(visits, visit)], ["id", "label", "copies", "vector", "a", "b", "visits"])

    return run


def joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For ``n`` points, the least one that links ``(p, q)`` reach from each."""
    label = np.arange(n)
    while len(p):
        least = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        label = label[label]
        if (label == before).all():
            break
    return label


_LINK = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def _compare(threshold: float):
    """Links between the vectors that visit a row of the grid and those that lie there, as counts and a forest."""

    def run(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _LINK.empty_table()
        q, v = _matrix(asked.column("vector")), _matrix(held.column("vector"))
        q_norm, v_norm = np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1)
        q_ids, v_ids, v_cell = asked.column("id").to_numpy(), held.column("id").to_numpy(), held.column("b").to_numpy()
        js = asked.column("js").combine_chunks()
        visitor, column = np.repeat(np.arange(len(q)), js.value_lengths().to_numpy()), js.flatten().to_numpy()
        ps, vs = [], []
        for j in np.unique(v_cell):
            some, here = visitor[column == j], np.flatnonzero(v_cell == j)
            if len(some):
                near = (q[some] @ v[here].T) / (q_norm[some][:, None] * v_norm[here]) >= threshold
                near &= q_ids[some][:, None] != v_ids[here]
                x, y = np.nonzero(near)
                ps.append(some[x])
                vs.append(here[y])
        p, r = (np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64) for x in (ps, vs))
        if not len(p):
            return _LINK.empty_table()
        ids, at = np.unique(np.concatenate([q_ids, v_ids]), return_inverse=True)
        own, other = at[: len(q)], at[len(q) :]
        # Vectors of one cell meet twice; others once, which counts for both.
        same = (asked.column("a").to_numpy()[p] == key[2].as_py()) & (asked.column("b").to_numpy()[p] == v_cell[r])
        n = np.bincount(own[p], weights=held.column("copies").to_numpy()[r], minlength=len(ids))
        n += np.bincount(other[r[~same]], weights=asked.column("copies").to_numpy()[p[~same]], minlength=len(ids))
        label = joined(len(ids), own[p], other[r])
        some = np.flatnonzero((n > 0) | (label != np.arange(len(ids))))
        return pa.table([pa.array(ids[some]), pa.array(n[some].astype(np.int64)), pa.array(ids[label[some]])], schema=_LINK)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, centroids: int | None = None, sample: int = SAMPLE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors``.

    Vectors are linked if their labels are equal and not null and their cosine is at least ``threshold``.
    Codebooks of ``centroids`` entries for each half, or as many as give cells of about ``CELL`` vectors, are fitted on up to ``sample`` rows, all rows are
    indexed. Equal vectors of a label are compared once, with their number. ``n_links`` counts other rows
    linked directly; ``component_id`` is the smallest id that links reach.

    Vectors that are null, empty, all zero or hold a null or non-finite component, and rows whose label or id is null,
    link with nothing: their component is their own id. Vectors of different widths are never linked. Repeated
    rows are rows of their own, linked with each other. An empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"), F.col(label_column).cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(good, F.col("vector"))).withColumn("code", F.when(good, F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    classes = cut(rows.where(F.col("code").isNotNull()).groupBy("label", "code").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))
    # Ids may repeat with other vectors, so a class has a number of its own within this job. Floats are moved as floats.
    kind = "float" if dict(vectors.dtypes)[vector_column] == "array<float>" else "double"
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()).withColumn("vector", F.col("vector").cast(f"array<{kind}>")))
    k = centroids or min(MOST, max(2, round((classes.count() / CELL) ** 0.5)))
    taken = drawn(classes, sample, "code").select("vector").collect()
    codebooks = {}
    for width in {len(r.vector) for r in taken}:
        x = np.array([r.vector for r in taken if len(r.vector) == width], np.float64)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        codebooks[width] = (k_means(x[:, : width // 2], k), k_means(x[:, width // 2 :], k, 1))
    limit = (2 - 2 * threshold) * (1 + 1e-9) + 1e-9
    schema = f"id bigint, label string, copies bigint, vector array<{kind}>, a int, b int, visits array<struct<i:int,js:array<int>>>"
    placed = cut(classes.select("id", "label", "copies", "vector").mapInArrow(_place(codebooks, limit, pa.list_(pa.float32() if kind == "float" else pa.float64())), schema).withColumn("width", F.size("vector")))

    spot = ["label", "width", "i"]
    brief = placed.select("id", "label", "width", F.explode("visits.i").alias("i"))
    blocks = lambda rows, name: rows.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    grid = cut(blocks(placed.withColumn("i", F.col("a")), "v_blocks").join(blocks(brief, "q_blocks"), spot))
    part = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    asked = placed.select("id", "label", "width", "copies", "vector", "a", "b", F.inline("visits"))
    q = hub_join(asked, grid, *spot).withColumn("q", part("q_blocks")).withColumn("v", each("v_blocks"))
    v = hub_join(placed.withColumn("i", F.col("a")), grid, *spot).withColumn("v", part("v_blocks")).withColumn("q", each("q_blocks"))
    at = [*spot, "q", "v"]
    q, v = q.select(*at, "id", "js", "copies", "vector", "a", "b").toDF(*at, "id", "js", "copies", "vector", "a", "b"), v.select(*at, "id", "b", "copies", "vector").toDF(*at, "id", "b", "copies", "vector")
    links = cut(q.groupBy(*at).cogroup(v.groupBy(*at)).applyInArrow(_compare(threshold), "id bigint, n bigint, other bigint"))

    totals = links.groupBy("id").agg(F.sum("n").alias("n"))
    reps = classes.select("id", "rep")
    apart = links.select("id", "other").distinct().join(reps, "id").withColumnRenamed("rep", "a").drop("id").join(reps.withColumnRenamed("id", "other"), "other").select("a", F.col("rep").alias("b"))
    named = rows.where(F.col("code").isNotNull())
    several = named.groupBy("id").agg(F.min(F.struct("label", "code")).alias("x"), F.max(F.struct("label", "code")).alias("y")).where("x <> y").select("id")
    same = named.join(several, "id", "left_semi").join(classes.select("label", "code", "rep"), ["label", "code"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(apart.unionByName(same)).withColumnRenamed("id", "rep")
    home = classes.select("id", "rep", "label", "code", "copies").join(totals, "id", "left").join(found, "rep", "left").select("label", "code", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = named.select("id", "label", "code").join(home, ["label", "code"]).select("id", "n_links", "component_id")
    alone = rows.where(F.col("code").isNull()).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
