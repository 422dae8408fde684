"""Distances of blocks of vectors inside tasks, on Arrow batches.

Spark deals the rows; a task compares a block of pool rows with a block of queries. Sums go over the dimensions in their order, one dimension at a time for a whole block, so that distances are the same numbers
that the expressions of ``vec`` and SQL give, and are rounded as SQL rounds. Only vectors that ``regular`` takes come here: of one width, without nulls and with numbers whose squares are finite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from affinis.functions import vec

#: Numbers of a tile that stays in a core's cache, queries of a tile, and rows of a strip and of a chunk of the pool that is searched at once.
TILE, QUERY_TILE, STRIP, CHUNK = 8_192, 2_048, 1_024, 16_384
#: Rows of an emitted batch.
BATCH = 65_536
#: Pairs of a task where all pairs are emitted and where only the nearest are, and tasks up to which searches are cut as finely as that.
PAIRS, SEARCHED, FEW_TASKS = 1 << 22, 1 << 26, 64
#: Tasks of a kernel or a matrix at most.
MOST_TASKS = 2_000
#: Absolute values that the blocks take lie between these, or are 0.
LEAST, MOST = 1e-140, 1e140

Step = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]


def _differences(x, y, acc, t, s):
    np.subtract(x, y, out=t)
    np.multiply(t, t, out=t)
    np.add(acc, t, out=acc)


def _products(x, y, acc, t, s):
    np.multiply(x, y, out=t)
    np.add(acc, t, out=acc)


def _least(x, y, acc, t, s):
    np.minimum(x, y, out=t)
    np.add(acc, t, out=acc)


def _absolute(x, y, acc, t, s):
    np.subtract(x, y, out=t)
    np.abs(t, out=t)
    np.add(acc, t, out=acc)


def _cubes(x, y, acc, t, s):
    np.subtract(x, y, out=t)
    np.abs(t, out=t)
    np.multiply(t, t, out=s)
    np.multiply(s, t, out=t)
    np.add(acc, t, out=acc)


def _greatest(x, y, acc, t, s):
    np.subtract(x, y, out=t)
    np.abs(t, out=t)
    np.maximum(acc, t, out=acc)


def _chi(x, y, acc, t, s):
    np.add(x, y, out=s)
    np.subtract(x, y, out=t)
    np.multiply(t, t, out=t)
    bare = s <= 0
    if bare.any():
        t[bare], s[bare] = 0, 1
    np.divide(t, s, out=t)
    np.add(acc, t, out=acc)


def _relative(x, y, acc, t, s):
    np.copyto(s, y)
    with np.errstate(divide="ignore", invalid="ignore"):
        np.divide(y, x, out=t)
        np.log(t, out=t)
    np.multiply(s, t, out=t)
    bare = (s <= 0) | (np.broadcast_to(x, t.shape) <= 0)
    if bare.any():
        t[bare] = 0
    np.add(acc, t, out=acc)


STEPS: dict[str, Step] = {
    "euclidean": _differences, "squared_euclidean": _differences, "cosine": _products, "cosine_similarity": _products, "hik": _least, "chi_square": _chi, "manhattan": _absolute, "minkowski3": _cubes,
    "chebyshev": _greatest, "hellinger": _differences, "divergence": _relative,
}
#: ``divergence`` is that of Kullback and Leibler, of the query from the row. Distances that one product of matrices bounds:
BY_PRODUCT = ("euclidean", "squared_euclidean", "cosine")


def name_of(by: str | Callable) -> str | None:
    """The name of a metric that blocks know, else null."""
    return by if isinstance(by, str) and by in STEPS else "cosine_similarity" if by is vec.cosine else None


def regular(vector: Column, name: str, width: int) -> Column:
    """Whether blocks may take a vector; never null."""
    fine = (F.size(vector) == width) & F.forall(vector, lambda x: (F.abs(x) < MOST) & ((F.abs(x) > LEAST) | (x == 0)))
    if name.startswith("cosine"):
        fine = fine & F.exists(vector, lambda x: x != 0)
    if name == "hellinger":
        fine = fine & F.forall(vector, lambda x: x >= 0)
    return F.coalesce(fine, F.lit(False))


def rounded(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Halves go away from zero, of the number times a power of ten, as in SQL."""
    if not digits:
        return x
    scale = float(10**digits)
    y = x * scale
    out = np.rint(y)
    halves = np.abs(y - out) == 0.5
    if halves.any():
        out[halves] = np.trunc(y[halves]) + np.sign(y[halves])
    out /= scale
    out += 0.0
    return out


class Side:
    """Vectors of one side, by dimension, with what a metric needs of each."""

    def __init__(self, name: str, x: np.ndarray):
        self.x = x
        self.t = np.ascontiguousarray((np.sqrt(x) if name == "hellinger" else x).T)
        self.norms = self.squares = None
        if name in BY_PRODUCT or name.startswith("cosine"):
            self.squares = np.zeros(len(x))
            for row in self.t:
                self.squares += row * row
            self.norms = np.sqrt(self.squares)

    def __len__(self):
        return len(self.x)


def _finish(name: str, acc: np.ndarray, norms_a, norms_b) -> np.ndarray:
    if name == "euclidean":
        return np.sqrt(acc, out=acc)
    if name == "hik":
        return np.subtract(1.0, acc, out=acc)
    if name.startswith("cosine"):
        acc /= norms_a * norms_b
        if name == "cosine":
            np.clip(acc, -1.0, 1.0, out=acc)
            np.arccos(acc, out=acc)
            acc *= 2.0
            acc /= np.pi
    return acc


def block(name: str, a: Side, b: Side, rows: slice) -> np.ndarray:
    """Distances of some rows of ``a`` with all of ``b``."""
    step, at = STEPS[name], a.t[:, rows]
    out = np.empty((at.shape[1], len(b)))
    wide = min(len(b), QUERY_TILE)
    tall = max(1, TILE // max(1, wide))
    for q in range(0, len(b), wide):
        bt = b.t[:, q : q + wide]
        for r in range(0, len(out), tall):
            part = at[:, r : r + tall]
            shape = (part.shape[1], bt.shape[1])
            acc, t, s = np.zeros(shape), np.empty(shape), np.empty(shape)
            for x, y in zip(part, bt, strict=True):
                step(x[:, None], y, acc, t, s)
            out[r : r + tall, q : q + wide] = acc
    norms = (a.norms[rows][:, None], b.norms) if a.norms is not None else (None, None)
    return _finish(name, out, *norms)


def by_product(name: str, a: Side, b: Side, rows: slice, digits: int) -> np.ndarray | None:
    """What ``block`` gives, rounded, for some metrics: a product of matrices, and exact sums where its error could change the last digit; null if that could be anywhere."""
    x, scale = a.x[rows], float(10**digits)
    largest = max(float(np.abs(x).max()), float(np.abs(b.x).max()), 1.0) ** 2 * x.shape[1]
    if name == "divergence":
        if x.min() <= 0 or b.x.min() <= 0:
            return None
        out = np.log(x) @ -b.x.T
        out += (b.x * np.log(b.x)).sum(axis=1)
        largest *= max(1.0, float(-np.log(min(x.min(), b.x.min()))), float(np.log(largest)))
        unsure = None
    elif name in ("cosine", "cosine_similarity"):
        out = x @ b.x.T
        out /= a.norms[rows][:, None] * b.norms
        unsure, largest = np.abs(out) > 0.999 if name == "cosine" else None, 1.0
        if name == "cosine":
            np.clip(out, -1.0, 1.0, out=out)
            np.arccos(out, out=out)
            out *= 2 / np.pi
    elif name == "euclidean":
        out, squares = x @ b.x.T, a.squares[rows][:, None] + b.squares
        out *= -2.0
        out += squares
        unsure = out < 1e-3 * squares
        np.maximum(out, 0, out=out)
        np.sqrt(out, out=out)
    else:
        return None
    if (near := scale * 1e-12 * largest) > 0.01:
        return None
    out *= scale
    whole = np.rint(out)
    out -= whole
    np.abs(out, out=out)
    check = out > 0.5 - near
    if unsure is not None:
        check |= unsure
    i, j = np.nonzero(check)
    whole /= scale
    whole += 0.0
    if len(i):
        whole[i, j] = rounded(of_pairs(name, a, i + rows.start, b, j), digits)
    return whole


def of_pairs(name: str, a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Distances of row ``i[k]`` of ``a`` with row ``j[k]`` of ``b``."""
    out = np.empty(len(i))
    for k in range(0, len(i), TILE):
        p, q = i[k : k + TILE], j[k : k + TILE]
        acc, t, s = np.zeros(len(p)), np.empty(len(p)), np.empty(len(p))
        for x, y in zip(a.t, b.t, strict=True):
            STEPS[name](x[p], y[q], acc, t, s)
        norms = (a.norms[p], b.norms[q]) if a.norms is not None else (None, None)
        out[k : k + TILE] = _finish(name, acc, *norms)
    return out


def _cut(q: np.ndarray, d: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` least ``(d, r)`` of each ``q``, by ``q``."""
    order = np.lexsort((r, d, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[place < n]


def nearest(name: str, a: Side, b: Side, n: int, digits: int | None, most: np.ndarray, admitted: Callable[[slice, slice], np.ndarray] | None = None, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of b, row of a, distance)`` of the ``n`` rows of ``a`` nearest to each row of ``b``, ties by ``place``, at first that in ``a``.

    None farther than ``most`` is looked for; that is lowered to what was found. ``admitted`` tells which pairs count. Where a product of matrices bounds the distances, only
    pairs that it can't rule out are compared exactly; the bounds are wider than its error and what rounding hides.
    """
    slack = max(10.0**-digits if digits else 0.0, 1e-6)
    product = name in BY_PRODUCT
    place = np.arange(len(a)) if place is None else place
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q0 in range(0, len(b), QUERY_TILE):
        q1 = min(len(b), q0 + QUERY_TILE)
        tile = Side(name, b.x[q0:q1])
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        limit, held = most[q0:q1].copy(), 0

        def settle(kept=kept, limit=limit):
            q, r, d = (np.concatenate(x) for x in zip(*kept, strict=True))
            best = _cut(q, d, place[r], n)
            q, r, d = q[best], r[best], d[best]
            full = np.flatnonzero(np.bincount(q, minlength=len(limit)) >= n)
            last = np.searchsorted(q, full, "right") - 1
            limit[full] = np.minimum(limit[full], d[last])
            kept[:] = [(q, r, d)]

        for r0 in range(0, len(a), STRIP):
            rows, some = slice(r0, min(len(a), r0 + STRIP)), None
            part, ends = tile, limit
            if admitted is not None:
                counts = admitted(rows, slice(q0, q1))
                asking = np.flatnonzero(counts.any(axis=0))
                if not len(asking):
                    continue
                if len(asking) < 0.8 * len(tile):
                    # Only the queries that these rows concern.
                    some, counts = asking, counts[:, asking]
                    part, ends = Side(name, tile.x[some]), limit[some]
            if product:
                score = a.x[rows] @ part.x.T
                if name == "cosine":
                    score /= a.norms[rows][:, None] * -part.norms
                else:
                    score *= -2.0
                    score += a.squares[rows][:, None]
                    score += part.squares
                error = 1e-12 if name == "cosine" else 1e-12 * (a.squares[rows].max() + part.squares)
            else:
                score, error = block(name, a, part, rows), 0.0
            if admitted is not None:
                score[~counts] = np.nan
            if np.isinf(ends).any() and len(score) >= n:
                # The n-th of this strip bounds the answer.
                kth = np.partition(score, n - 1, axis=0)[n - 1] + error
                far = np.sqrt(np.maximum(kth, 0)) if name == "euclidean" else 2 * np.arccos(np.clip(-kth, -1, 1)) / np.pi if name == "cosine" else kth
                ends = np.fmin(ends, np.where(np.isnan(far), np.inf, far + slack))
                limit[slice(None) if some is None else some] = ends
            bound = ends + slack
            if name == "euclidean":
                bound = bound * bound
            elif name == "cosine":
                bound = np.where(bound >= 2, np.inf, -np.cos(np.minimum(bound, 2.0) * (np.pi / 2)))
            r, q = np.nonzero(score <= bound + error)
            if len(r):
                d = rounded(of_pairs(name, a, r + r0, part, q) if product else score[r, q], digits)
                kept.append((q if some is None else some[q], r + r0, d))
                held += len(r)
                if held > 4 * n * (q1 - q0):
                    settle()
                    held = len(kept[0][0])
        if kept:
            settle()
            most[q0:q1] = np.minimum(most[q0:q1], limit)
            q, r, d = kept[0]
            found.append((q + q0, r, d))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    q, r, d = (np.concatenate(x) for x in zip(*found, strict=True))
    return q, r, d


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    out = column.combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks) if out.num_chunks else pa.array([], out.type)


def emitted(schema: pa.Schema, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema, strict=True)], schema=schema)
    for k in range(0, len(whole), BATCH):
        yield whole.slice(k, BATCH)


def all_pairs(names: list[str], digits: int | None, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Strips of rows of ``a``, and their distances from all of ``b`` by each metric, as vectors that run over ``b`` first."""
    one, two = {n: Side(n, a) for n in names}, {n: Side(n, b) for n in names}
    tall = max(1, BATCH // max(1, len(b)))
    for r in range(0, len(a), tall):
        rows = slice(r, min(len(a), r + tall))
        found = [by_product(n, one[n], two[n], rows, digits) if digits else None for n in names]
        yield rows, [(rounded(block(n, one[n], two[n], rows), digits) if d is None else d).ravel() for n, d in zip(names, found, strict=True)]


class Queries:
    """A block of queries that all tasks get."""

    def __init__(self, ids: pa.Array, x: np.ndarray, keys: np.ndarray | None = None):
        self.ids, self.x, self.keys = ids, x, keys


def gathered(queries: DataFrame, most: int, extra: list[str] = ()) -> pa.Table | None:
    """The queries on the driver, or null if there are more than ``most``."""
    got = queries.select("qid", "qvector", *extra).limit(most + 1).toArrow()
    return got if len(got) <= most else None


def few(got: pa.Table, names: list[str]) -> bool:
    """Whether blocks may take all of the queries."""
    x = got["qvector"]
    if not len(got) or x.null_count or x.type.value_type not in (pa.float64(), pa.float32()):
        return False
    flat, sizes = pc.list_flatten(x), pc.unique(pc.list_value_length(x))
    if len(sizes) != 1 or not sizes[0].as_py() or flat.null_count:
        return False
    m = np.abs(matrix_of(x))
    fine = bool(np.all((m < MOST) & ((m > LEAST) | (m == 0))))
    if any(n.startswith("cosine") for n in names):
        fine = fine and bool(m.any(axis=1).all())
    return fine and not ("hellinger" in names and bool((matrix_of(x) < 0).any()))


def arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def dealt(pool: DataFrame, pairs: int, searched: bool) -> DataFrame:
    """The pool in as many parts as the work asks for."""
    parts = pairs // PAIRS
    if searched:
        parts = min(parts, max(FEW_TASKS, pairs // SEARCHED))
    return pool.repartition(int(parts), pool.columns[0]) if parts > 1 else pool


def pairs(queries: DataFrame, got: pa.Table, pool: DataFrame, names: dict[str, str], digits: int | None) -> DataFrame:
    """``(qid, uid, ...)`` of all ``pool (uid, vector)`` rows and queries, with a distance for each name of a column and metric."""
    schema = StructType([queries.schema["qid"], pool.schema["uid"], *[StructField(c, DoubleType()) for c in names]])
    out, metrics = arrow_schema(schema), list(names.values())
    shared = pool.sparkSession.sparkContext.broadcast((_whole(got["qid"]), matrix_of(got["qvector"])))

    def run(batches):
        qids, q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            uids = batch.column(0)
            for rows, dists in all_pairs(metrics, digits, matrix_of(batch.column(1)), q):
                i = np.repeat(np.arange(rows.start, rows.stop), len(q))
                j = np.tile(np.arange(len(q)), rows.stop - rows.start)
                yield from emitted(out, [qids.take(pa.array(j)), uids.take(pa.array(i)), *[pa.array(d) for d in dists]])

    rows = pool.select("uid", "vector")
    return dealt(rows, rows.count() * len(got), False).mapInArrow(run, schema)


def search(queries: DataFrame, got: pa.Table, pool: DataFrame, name: str, n: int, digits: int | None, skip_self: bool = False, admit: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(qid, uid, dist)``: candidates among which are the ``n`` nearest ``pool (uid, vector)`` rows of each query: the nearest of each chunk.

    With ``admit``, the pool has ``keys`` and ``got`` has them too, arrays of ints of one length: a pair counts where ``admit(keys of rows, keys of queries)`` says so.
    """
    schema = StructType([queries.schema["qid"], pool.schema["uid"], StructField("dist", DoubleType())])
    out = arrow_schema(schema)
    keys = matrix_of(got["keys"]).astype(np.int32) if admit else None
    shared = pool.sparkSession.sparkContext.broadcast((_whole(got["qid"]), matrix_of(got["qvector"]), keys))

    def run(batches):
        qids, x, qkeys = shared.value
        b = Side(name, x)
        most = np.full(len(x), np.inf)
        known = pc.unique(qids)
        number = pc.index_in(qids, value_set=known).to_numpy(zero_copy_only=False) if skip_self else None

        def of(chunk: list[pa.RecordBatch]):
            table = pa.Table.from_batches(chunk)
            # Places follow the order of the ids, which breaks ties; rows of equal keys are compared together.
            table = table.take(pc.sort_indices(table["uid"]))
            place = np.arange(len(table))
            if admit:
                place = np.argsort(matrix_of(table["keys"])[:, 0], kind="stable")
                table = table.take(pa.array(place))
            uids, a = _whole(table["uid"]), Side(name, matrix_of(table["vector"]))
            rkeys = matrix_of(table["keys"]).astype(np.int32) if admit else None
            own = pc.index_in(uids.cast(qids.type), value_set=known).to_numpy(zero_copy_only=False) if skip_self else None

            def admitted(rows: slice, tile: slice) -> np.ndarray:
                fine = admit(rkeys[rows], qkeys[tile]) if admit else np.ones((rows.stop - rows.start, tile.stop - tile.start), bool)
                if skip_self:
                    for i in np.flatnonzero(~np.isnan(own[rows].astype(float))):
                        fine[i, number[tile] == own[rows][i]] = False
                return fine

            q, r, d = nearest(name, a, b, n, digits, most, admitted if admit or skip_self else None, place)
            return emitted(out, [qids.take(pa.array(q)), uids.take(pa.array(r)), pa.array(d)])

        chunk, held = [], 0
        for batch in batches:
            if len(batch):
                chunk.append(batch)
                held += len(batch)
            if held >= CHUNK:
                yield from of(chunk)
                chunk, held = [], 0
        if chunk:
            yield from of(chunk)

    rows = pool.select("uid", "vector", *["keys"] * bool(admit))
    return dealt(rows, rows.count() * len(got), True).mapInArrow(run, schema)


def listed(found: DataFrame, got: pa.Table, name: str, digits: int | None) -> DataFrame:
    """``(qid, uid, dist)`` of the pairs ``found (qid, uid, vector)`` with the queries ``got``, whose ids differ."""
    schema = StructType([found.schema["qid"], found.schema["uid"], StructField("dist", DoubleType())])
    out = arrow_schema(schema)
    shared = found.sparkSession.sparkContext.broadcast((_whole(got["qid"]), matrix_of(got["qvector"])))

    def run(batches):
        qids, x = shared.value
        b = Side(name, x)
        for batch in batches:
            if len(batch):
                a, j = Side(name, matrix_of(batch.column(2))), pc.index_in(batch.column(0), value_set=qids).to_numpy(zero_copy_only=False)
                yield from emitted(out, [batch.column(0), batch.column(1), pa.array(rounded(of_pairs(name, a, np.arange(len(batch)), b, j), digits))])

    return found.select("qid", "uid", "vector").mapInArrow(run, schema)


def in_blocks(rows: DataFrame, spot: list[str], name: str, digits: int | None, groups: int, mirrored: bool, kept: list[str] = (), carried: list[str] = ()) -> DataFrame:
    """``(row_id, col_id, dist, ...)`` of the pairs of each group of ``rows (uid, vector, side, ...)`` that share ``spot``: those of side 0 with those of side 1, and all of side 2 with one another.

    ``mirrored`` gives both cells of a pair of sides 0 and 1. ``kept`` columns are of the group, ``carried`` ones of each row and column. Groups are dealt to about as many tasks.
    """
    schema = StructType([StructField("row_id", rows.schema["uid"].dataType), StructField("col_id", rows.schema["uid"].dataType), StructField("dist", DoubleType()), *[rows.schema[c] for c in kept]])
    for c in carried:
        schema = schema.add(f"row_{c}", rows.schema[c].dataType).add(f"col_{c}", rows.schema[c].dataType)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table["side"].to_numpy()
        whole = table.filter(pa.array(side == 2))
        a, b = (whole, whole) if len(whole) else (table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)))
        if not len(a) or not len(b):
            return
        ids, own = [_whole(x["uid"]) for x in (a, b)], [[_whole(x[c]) for c in carried] for x in (a, b)]
        fixed = [table[c][0] for c in kept]
        for strip, (dist,) in all_pairs([name], digits, matrix_of(a["vector"]), matrix_of(b["vector"])):
            i = pa.array(np.repeat(np.arange(strip.start, strip.stop), len(b)))
            j = pa.array(np.tile(np.arange(len(b)), strip.stop - strip.start))
            one, two, d = ids[0].take(i), ids[1].take(j), pa.array(dist)
            same = [pa.repeat(x, len(d)) for x in fixed]
            flags = [(x.take(i), y.take(j)) for x, y in zip(*own, strict=True)]
            yield from emitted(out, [one, two, d, *same, *[x for pair in flags for x in pair]])
            if mirrored and not len(whole):
                yield from emitted(out, [two, one, d, *same, *[x for pair in flags for x in pair[::-1]]])

    rows = rows.select("uid", "vector", *spot, *carried, "side")
    return rows.repartition(max(1, min(groups, MOST_TASKS)), *spot).groupBy(*spot).applyInArrow(run, schema)
