"""Distances of blocks of vectors against the expressions that they stand for, and against plain NumPy."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis import queries as core
from affinis.functions import vec
from affinis.operators import dense, knn

DIR = "/root/testdata/sf0.001"
SCHEMA = "uid bigint, vector array<double>, label int"


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0 if labels is None else labels[i]) for i, v in enumerate(x)], SCHEMA)


def ask(rows, every=7):
    return rows.where(F.col("uid") % every == 0).select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))


def in_tasks(df) -> bool:
    """Whether blocks of vectors are compared in tasks instead of pairs in expressions."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "MapInArrow" in plan or "FlatMapGroupsInArrow" in plan


def near(got, want, digits=9):
    plain = lambda rows: sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    return plain(got) == plain(want)


@pytest.mark.parametrize("metric", [*vec.METRICS, vec.cosine])
def test_all_pairs(spark, metric):
    """Also of rows that blocks don't take: null, zero, of another width, with nulls."""
    rng = np.random.default_rng(0)
    x = [*rng.random((90, 5)), [0.0] * 5, [1.0] * 4, None, [1.0, None, 0.5, 0.2, 0.1][:1]]
    rows, queries = table(spark, x), ask(table(spark, x[:60]))
    for digits in (None, 4):
        got = knn.pairs(queries, rows, metric, digits)
        assert in_tasks(got) and near(got.collect(), knn._plain_pairs(queries, rows, metric, digits).collect())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_family_in_blocks(spark):
    """several distances of all pairs, by blocks and as their expressions."""
    got = core.QUERIES["dist_family"](spark, DIR)
    assert in_tasks(got)
    rows = core.histograms(spark, DIR)
    a, b = F.col("qvector"), F.col("vector")
    want = knn.crossed(rows, core.asked(rows), "qid").select("qid", "uid", *[F.round(x, 6) for x in (vec.manhattan(a, b), vec.minkowski(a, b, 3), vec.chebyshev(a, b), vec.hellinger(a, b), vec.kullback_leibler(a, b))])
    assert near(got.collect(), want.collect(), 6)


def test_last_digits():
    """What a product of matrices leaves open is summed exactly; halves are rounded as in SQL."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 16))
    x[1] = x[0]
    x[2] = x[0] * (1 + 1e-9)
    for name in ("euclidean", "cosine", "cosine_similarity", "divergence"):
        v = np.abs(x) + 0.01 if name == "divergence" else x
        side = dense.Side(name, v)
        exact = dense.rounded(dense.block(name, side, side, slice(0, 300)), 6)
        assert (dense.by_product(name, side, side, slice(0, 300), 6) == exact).all()
    assert dense.rounded(np.array([0.5, 1.5, -0.5, 2.4999999, 3 / 3200 * 1e6]) / 1e6, 6).tolist() == [1e-6, 2e-6, -1e-6, 2e-6, 938e-6]


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "hik", "chi_square", "squared_euclidean"])
@pytest.mark.parametrize("digits", [None, 2])
def test_nearest_of_tasks(spark, metric, digits, monkeypatch):
    """Few digits make many ties, which go by id."""
    monkeypatch.setattr(dense, "PAIRS", 400)
    rng = np.random.default_rng(2)
    x = rng.random((220, 4))
    x[40:80] = x[40]
    rows = table(spark, x)
    for skip in (False, True):
        got = knn.nearest_batch(ask(rows), rows, 5, metric, digits, skip)
        assert in_tasks(got)
        assert near(got.collect(), knn.top(knn._plain_pairs(ask(rows), rows, metric, digits), 5, skip).collect())


@pytest.mark.parametrize("name", ["euclidean", "cosine", "hik"])
def test_nearest_in_strips(name, monkeypatch):
    """Strips and tiles are cut anywhere, and some pairs don't count."""
    for c, value in (("STRIP", 16), ("QUERY_TILE", 9), ("TILE", 64)):
        monkeypatch.setattr(dense, c, value)
    rng = np.random.default_rng(3)
    x, y = rng.random((300, 4)), rng.random((40, 4))
    x[50:90] = x[50]
    a, b, counts = dense.Side(name, x), dense.Side(name, y), rng.random((300, 40)) < 0.3
    counts[:, 0] = False
    q, r, d = dense.nearest(name, a, b, 5, 2, np.full(40, np.inf), lambda rows, tile: counts[rows, tile])
    whole = np.where(counts, dense.rounded(dense.block(name, a, b, slice(0, 300)), 2), np.inf)
    want = {(j, int(i)) for j in range(1, 40) for i in np.lexsort([np.arange(300), whole[:, j]])[:5]}
    assert set(zip(q.tolist(), r.tolist(), strict=True)) == want and (d == whole[r, q]).all()


def test_plan_of_a_deep_kd_tree(spark):
    """the plan of a search grows with the depth, not with its power of two."""
    from affinis.operators import trees

    rng = np.random.default_rng(6)
    x = np.round(rng.random((600, 3)), 2)
    rows = table(spark, x)
    built, nodes, depth = trees.kd_build(rows, 4)
    names, cut = [], trees.cut
    trees.cut = lambda df: names.append(df._jdf.queryExecution().logical().toString().count("Join")) or cut(df)
    try:
        found, _ = trees.kd_search(built, nodes, depth, ask(rows), 5, digits=1)
    finally:
        trees.cut = cut
    assert depth == 8 and max(names) <= 3 * depth
    assert near(found.collect(), knn.nearest_batch(ask(rows), rows, 5, "euclidean", 1).collect())


def test_medians_of_large_nodes(spark, monkeypatch):
    from affinis.operators import mrpt

    monkeypatch.setattr(mrpt, "ACCURACY", 40)
    rng = np.random.default_rng(5)
    p = {(0, 1): rng.random(3001), (1, 1): np.r_[np.full(500, 0.5), rng.random(700)], (1, 2): rng.random(9)}
    rows = spark.createDataFrame([(t, n, float(x)) for (t, n), xs in p.items() for x in xs], "tree int, node int, p double")
    assert mrpt.medians(rows) == {k: float(np.sort(x)[(len(x) + 1) // 2 - 1]) for k, x in p.items()}


@pytest.mark.parametrize("kind", ["lsh", "ivf", "mrpt", "kdtree"])
def test_indexes_in_blocks(spark, kind, monkeypatch):
    """an index finds in blocks what a join of its hits finds."""
    from affinis.plans.indexes import Ivf, KdTree, Lsh, Mrpt

    rng = np.random.default_rng(7)
    rows = table(spark, np.round(rng.normal(0, 1, (400, 6)), 1))
    index = {"lsh": Lsh(bits=5, n_codes=6, functor="random"), "ivf": Ivf(cells=9, probes=2), "mrpt": Mrpt(3, 4), "kdtree": KdTree(3, 4)}[kind].build(rows)
    got = index.search(ask(rows), 5)
    assert in_tasks(got)
    monkeypatch.setattr(knn, "nearest_admitted", lambda *_: None)
    assert near(got.collect(), index.search(ask(rows), 5).collect())


def test_libsvm_keeps_numbers(spark):
    """a value written with twelve digits is rounded twice."""
    from affinis.sources import files

    x = [0.12345649999999999, 1e-13, -3.0000000000000004, 0.0, float(np.float32(0.1))]
    rows = table(spark, [x])
    assert files.parse_libsvm(files.libsvm_lines(rows), 5).first()["vector"] == x


def test_rounding_as_in_sql(spark):
    """3 / 3200 and 41 / 640 are halves in decimal, but not times a million in binary."""
    import duckdb

    values = [a / b for b in (320, 640, 1280, 1600, 3200, 6400) for a in range(b)] + [0.0, -41 / 640, -0.5e-6, 0.4999999e-6]
    rows = spark.createDataFrame([(x,) for x in values], "x double")
    got = rows.select("x", vec.rounded(F.col("x")).alias("r"), F.round("x", 6).alias("plain")).toPandas()
    want = duckdb.sql("SELECT x, round(x, 6) AS r FROM got").df()
    assert (got["r"] == want["r"]).all() and (got["plain"] != want["r"]).any()


def test_letters_as_in_sql(spark):
    from affinis.plans import descriptors

    text = "a" * 41 + "x" * 599
    rows = spark.createDataFrame([("u", text.encode(), "text/plain")], "uid string, content binary, content_type string")
    found = descriptors.compute(rows, descriptors.Letters()).select(core._rounded("vector").alias("v")).first()["v"]
    assert found[0] == 0.064062 and descriptors.compute_transformed(rows, {"whole": lambda c: c}, descriptors.Letters()).select(core._rounded("vector").alias("v")).first()["v"][0] == 0.064062


def test_ranks_of_rounded_distances(spark, tmp_path):
    """what rounding makes equal is ranked by id."""
    from affinis.operators import hashing
    from affinis.plans import stored
    from affinis.plans.indexes import Exact, Lsh

    rows = table(spark, [[0.3, 0.7], [0.3001, 0.6999], [0.3, 0.7]])
    queries = rows.where("uid = 2").select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))
    for metric in ("chi_square", "euclidean"):
        assert [r["uid"] for r in Exact(metric, digits=2).build(rows.where("uid > 0")).search(queries, 2).orderBy("rank").collect()] == [1, 2]
    index = Lsh(bits=2, n_codes=4, functor="random")
    index.projection = hashing.Projection([[1.0, 1.0], [1.0, -1.0]])
    saved = stored.save(index.build(rows.where("uid > 0")), str(tmp_path / "index"))
    assert [r["uid"] for r in saved.search(queries, 2, digits=2).orderBy("rank").collect()] == [1, 2]


def test_table_function_gets_few_rows(spark):
    """F8: the table function ranks the nearest rows of each task, not all pairs."""
    rng = np.random.default_rng(8)
    rows = table(spark, rng.random((300, 4))).coalesce(2)
    found = knn.nearest_pairs(ask(rows), rows, 3, "euclidean", 6)
    assert found.count() <= 2 * 3 * ask(rows).count() < 300 * ask(rows).count() / 10
    assert near(knn.top(found, 3).collect(), knn.top(knn._plain_pairs(ask(rows), rows, "euclidean", 6), 3).collect())


def test_sql_functions_of_vectors(spark):
    """by Arrow batches, also of nulls, zeros and vectors of other widths."""
    from affinis.plans import sql

    names = sql.register(spark)
    assert {"euclidean_distance", "cosine_likeness", "angular_distance", "intersection_distance", "crop_tiles"} <= set(names)
    x = [[0.1, 0.5, 0.4], [0.0, 0.0, 0.0], [1.0, 2.0], None, [0.3, None, 0.7], [], [-1.0, 0.2, 3.0]]
    rows = table(spark, x)
    pairs = rows.crossJoin(ask(rows, 1))
    a, b = F.col("vector"), F.col("qvector")
    got = pairs.selectExpr("qid", "uid", *[f"{n}(vector, qvector)" for n in sql.VECTORS])
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    want = pairs.select("qid", "uid", vec.euclidean(a, b), vec.cosine(a, b), vec.angular(vec.cosine(a, b)), vec.hik(a, b))
    fine = lambda r: r["qid"] not in (1, 3, 4, 5) and r["uid"] not in (1, 3, 4, 5)
    assert near(filter(fine, got.collect()), filter(fine, want.collect()))
    plain = {(r[0], r[1]): r for r in want.collect()}
    assert all(r[2] == plain[r[0], r[1]][2] and r[3] == plain[r[0], r[1]][3] and r[4] == pytest.approx(plain[r[0], r[1]][4]) and r[5] == pytest.approx(plain[r[0], r[1]][5]) for r in got.collect())


@pytest.mark.parametrize("width", [70, 130])
def test_wide_codes_in_blocks(spark, width, monkeypatch):
    """nearest codes of several words by counts of bits; ties by code."""
    from affinis.operators import hashing, lsh

    rng = np.random.default_rng(9)
    rows = hashing.with_codes(table(spark, rng.normal(0, 1, (150, 5))), hashing.random_projection(5, width)).select("uid", "vector", "code")
    queries = rows.where("uid % 15 = 0").select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"), F.col("code").alias("qcode"))
    calls, own = [], lsh._wide_codes
    monkeypatch.setattr(lsh, "_wide_codes", lambda *a: calls.append(own(*a)) or calls[-1])
    got, found = lsh.nearest_codes(rows, queries, 9, width).collect(), lsh.search(rows, queries, 4, width, n_codes=9, digits=3).collect()
    assert all(c is not None for c in calls) and len(got) == 90
    monkeypatch.setattr(lsh, "_wide_codes", lambda *_: None)
    monkeypatch.setattr(lsh, "_members", lambda *_: None)
    plain = lambda rs: sorted(map(str, rs))
    assert plain(got) == plain(lsh.nearest_codes(rows, queries, 9, width).collect()) and near(found, lsh.search(rows, queries, 4, width, n_codes=9, digits=3).collect())


def test_kernels_in_blocks(spark, monkeypatch):
    """blocks give the cells of a join of pairs; a focused kernel computes no others."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(10)
    rows = table(spark, rng.random((60, 3)), [int(x) for x in rng.integers(0, 3, 60)])
    flags = rows.where("uid % 3 = 0").select("uid"), rows.where("uid % 2 = 0").select("uid")
    other = rows.withColumn("label", F.col("label") + 1)
    new = rows.where("uid % 4 = 1")
    made = lambda: [knn.kernel(rows, "hik", 6, "label"), knn.matrix(other, rows, "euclidean", 6, "label"), knn.focused(rows, *flags, "hik", 6, "label"), knn.kernel_with(knn.kernel(rows.where("uid % 4 <> 1"), "hik", 6, "label"), rows.where("uid % 4 <> 1"), new, "hik", 6, "label")]
    cells = lambda df: df.select(*sorted(df.columns)).collect()
    first = made()
    assert all(in_tasks(x) for x in first)
    got = [cells(x) for x in first]
    monkeypatch.setattr(knn, "_for_blocks", lambda *_: False)
    for one, plain in zip(got, made(), strict=True):
        assert near(one, cells(plain), 6)
    assert near(got[2], cells(knn.focus(knn.kernel(rows, "hik", 6, "label"), *flags).drop("label")), 6)
