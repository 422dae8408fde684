import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import hashing, ivf, knn, lsh
from affinis.plans.indexes import INDEXES, Exact, Ivf, Lsh, Mrpt
from affinis.plans.registry import default_config, envelope, merge

SETTINGS = {"exact": {}, "lsh": {"bits": 4, "metric": "euclidean", "n_codes": 16}, "ivf": {"cells": 4, "probes": 4}, "mrpt": {"trees": 3, "depth": 2}, "kdtree": {"trees": 6, "depth": 2}, "graph": {"metric": "euclidean"}, "kd_exact": {"leaf": 16}, "kmeans_tree": {"leaf": 16, "budget": 64}}


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "uid bigint, vector array<double>")


def ask(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "qid bigint, qvector array<double>")


def make(name):
    return INDEXES.make(envelope(name, INDEXES.known[name], **SETTINGS[name]))


@pytest.mark.parametrize("name", SETTINGS)
def test_unit_vectors(spark, name):
    index = make(name).build(frame(spark, enumerate(np.eye(5))))
    got = index.search(ask(spark, [(3, np.eye(5)[3])]), 1).collect()
    assert [(r["uid"], r["dist"]) for r in got] == [(3, 0.0)]
    if name != "mrpt":
        got = index.search(ask(spark, [(0, np.zeros(5))]), 5).collect()
        assert [r["dist"] for r in got] == [1.0] * 5


@pytest.mark.parametrize("name", ["exact", "lsh", "ivf"])
def test_ordered_vectors(spark, name):
    rows = frame(spark, [(int(j), [j, 2 * j]) for j in np.random.default_rng(0).permutation(300)])
    index = INDEXES.make(envelope(name, INDEXES.known[name], **(SETTINGS[name] | ({"bits": 1} if name == "lsh" else {})))).build(rows)
    got = index.search(ask(spark, [(0, [0, 0])]), 5).orderBy("rank").collect()
    assert [r["uid"] for r in got] == [0, 1, 2, 3, 4]


def test_random_vectors_find_themselves(spark):
    x = np.random.default_rng(0).random((200, 16))
    rows, near = frame(spark, enumerate(x)), ask(spark, [(7, x[7]), (8, x[8] + 1e-4)])
    for name in SETTINGS:
        got = make(name).build(rows).search(near, 3).orderBy("qid", "rank").collect()
        assert [r["uid"] for r in got if r["rank"] == 1] == [7, 8]
        for q in (7, 8):
            dists = [r["dist"] for r in got if r["qid"] == q]
            assert dists == sorted(dists)


def test_more_probes_find_more(spark):
    x = np.random.default_rng(1).random((300, 8))
    rows, query = frame(spark, enumerate(x)), ask(spark, [(0, x[0])])
    centroids = ivf.fit_cells(rows, 16)
    indexed = ivf.assign(rows, centroids)
    few, all_ = (ivf.search(indexed, query, centroids, 64, p).count() for p in (1, 16))
    assert few < 64 and all_ == 64
    exact = knn.nearest_batch(query, rows, 64)
    assert ivf.recall(ivf.search(indexed, query, centroids, 64, 16), exact) == 1
    assert Ivf(cells=4, probes=4, reduce_to=4).build(rows).search(query, 5).count() == 5


@pytest.mark.parametrize("name", SETTINGS)
def test_update_and_remove(spark, name):
    index = make(name).build(frame(spark, enumerate(np.eye(5))))
    index.update(frame(spark, [(9, [1, 1, 0, 0, 0]), (4, [0, 0, 0, 1, 1])]))
    assert index.count() == 6
    index.remove(spark.createDataFrame([(0,), (1,)], "uid bigint"))
    assert index.count() == 4
    with pytest.raises(KeyError):
        index.remove(spark.createDataFrame([(77,)], "uid bigint"))
    assert index.search(ask(spark, [(4, [0, 0, 0, 1, 1])]), 1).first()["uid"] == 4


def test_guards(spark):
    with pytest.raises(knn.EmptyIndexError):
        Exact().search(ask(spark, [(0, [1])]))
    with pytest.raises(ValueError):
        Exact().build(frame(spark, []))
    with pytest.raises(ValueError):
        Lsh().build(frame(spark, enumerate(np.eye(9)))).search(spark.createDataFrame([(1, None)], "qid bigint, qvector array<double>"))


def test_quantization(spark):
    rows = frame(spark, [(i, [v, v]) for i, v in enumerate((-2, -1, 0, 1, 2))])
    fit = hashing.fit_itq(rows, 1)
    assert fit.mean == pytest.approx([0, 0]) and [abs(r[0]) for r in fit.matrix] == pytest.approx([0.5**0.5] * 2)
    x = np.random.default_rng(0).random((200, 12))
    fit = hashing.fit_itq(frame(spark, enumerate(x)), 6)
    m = np.array(fit.matrix)
    assert np.allclose(m.T @ m, np.eye(6), atol=1e-9)
    assert all(a >= b - 1e-6 for a, b in zip(fit.losses, fit.losses[1:]))
    wide = hashing.random_projection(12, 80)
    assert len(frame(spark, [(0, x[0])]).select(wide.code(F.col("vector"))).first()[0]) == 2


def test_buckets(spark):
    rows = spark.createDataFrame([(0, 0), (2, 0), (4, 0), (1, 1), (3, 1)], "uid bigint, code bigint")
    left = lsh.remove(rows, spark.createDataFrame([(1,), (2,), (3,)], "uid bigint"))
    assert [(r["code"], r["uids"]) for r in lsh.buckets(left).collect()] == [(0, [0, 4])]
    assert lsh.count(rows).first()[0] == 5
    moved = lsh.update(rows, spark.createDataFrame([(0, 1)], "uid bigint, code bigint"))
    assert sorted((r["code"], tuple(r["uids"])) for r in lsh.buckets(moved).collect()) == [(0, (2, 4)), (1, (0, 1, 3))]


@pytest.mark.parametrize("width", [2, 20])
def test_every_query_is_answered(spark, width, monkeypatch):
    monkeypatch.setattr(knn, "MOST_QUERIES", 7)
    codes, kinds = [0, 1, 2, 3, 2, 1], 4 if width == 2 else 50
    rows = spark.createDataFrame([(i, [float(c), 1.0], c) for i, c in enumerate(codes)], "uid bigint, vector array<double>, code bigint")
    asked = spark.range(50).select(F.col("id").alias("qid"), F.array(F.col("id") % 4 + 0.0, F.lit(1.0)).alias("qvector"), (F.col("id") % kinds).alias("qcode"))
    got = {(r["qid"], r["code"], r["bits"]) for r in lsh.nearest_codes(rows, asked, 2, width).collect()}
    want = {(q, c, b) for q in range(50) for b, c in sorted(((q % kinds ^ c).bit_count(), c) for c in range(4))[:2]}
    assert got == want
    found = lsh.search(rows, asked, 1, width, "euclidean", n_codes=4)
    assert found.select("qid").distinct().count() == 50


def test_kernel(spark):
    rows = frame(spark, [(0, [1, 0]), (1, [0, 1]), (2, [0.5, 0.5])])
    cells = knn.kernel(rows)
    assert {(r["row_id"], r["col_id"]): r["dist"] for r in cells.collect() if r["row_id"] == 0} == {(0, 0): 0, (0, 1): 1, (0, 2): 0.5}
    assert knn.asymmetries(cells).isEmpty() and cells.count() == 9
    assert knn.extract_rows(cells, rows.where("uid = 1")).count() == 3


def test_registry():
    assert default_config(Mrpt) == {"trees": 10, "depth": 4, "seed": 0, "squared": True}
    assert INDEXES.defaults()["type"] is None and "lsh" in INDEXES.defaults()
    with pytest.raises(ValueError):
        INDEXES.make({"type": "none"})
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert set(INDEXES.discover(variable="AFFINIS_NO_SUCH_VARIABLE")) == set(SETTINGS)
