"""Pairwise support vector machines against plain computations."""

import tracemalloc

import numpy as np
import pytest

from affinis.operators import learn, svm


def blobs(rng, n, centres, spread=0.6):
    y = rng.integers(0, len(centres), n)
    return np.array(centres)[y] + rng.normal(0, spread, (n, len(centres[0]))), y


def table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), f"c{k}") for i, (v, k) in enumerate(zip(x, y))], "uid bigint, vector array<double>, label string")


@pytest.mark.parametrize("kernel", [svm.Kernel(), svm.Kernel("rbf", 0.7), svm.Kernel("poly", 0.5, 2, 1.0), svm.Kernel("intersection")])
def test_dual_is_solved(kernel):
    """The primal and the dual objective meet, and equality and box constraints hold."""
    rng = np.random.default_rng(0)
    x, k = blobs(rng, 120, [[0.5, 0.5, 1], [1.2, 0.2, 0.4]])
    x = np.abs(x)
    y = np.where(k == 0, 1.0, -1.0)
    bound = np.where(y > 0, 2.0, 1.0)
    alpha, bias = svm.solve(kernel, x, y, bound, gap=1e-6)
    matrix = kernel.of(x, x)
    assert abs(alpha @ y) < 1e-9 and (alpha >= 0).all() and (alpha <= bound + 1e-12).all()
    margins = matrix @ (alpha * y) + bias
    curved = (alpha * y) @ matrix @ (alpha * y)
    primal, dual = curved / 2 + (bound * np.maximum(0, 1 - y * margins)).sum(), alpha.sum() - curved / 2
    assert abs(primal - dual) < 1e-3 * abs(dual)


def test_kernels_against_definitions():
    rng = np.random.default_rng(1)
    a, b = rng.random((4, 3)), rng.random((5, 3))
    for kernel, one in [(svm.Kernel(), lambda u, v: u @ v), (svm.Kernel("rbf"), lambda u, v: np.exp(-((u - v) ** 2).sum() / 3)), (svm.Kernel("poly", 2, 2, 1), lambda u, v: (2 * u @ v + 1) ** 2), (svm.Kernel("sigmoid", 2, 3, 1), lambda u, v: np.tanh(2 * u @ v + 1)), (svm.Kernel("intersection"), lambda u, v: np.minimum(u, v).sum())]:
        assert np.allclose(kernel.of(a, b), [[one(u, v) for v in b] for u in a]) and np.allclose(kernel.diagonal(a), [one(u, u) for u in a])
    with pytest.raises(ValueError):
        svm.Kernel("other").of(a, b)


def test_intersection_by_sorted_values():
    rng = np.random.default_rng(2)
    support, weights = np.round(rng.random((200, 7)), 1), rng.normal(size=200)
    x = np.concatenate([np.round(rng.random((50, 7)), 1), rng.normal(size=(50, 7)) * 3])
    assert np.allclose(svm.margin_of(svm.Kernel("intersection"), support, weights)(x), np.minimum(x[:, None], support[None]).sum(2) @ weights)


def test_coupling_minimises_the_pairs_disagreement():
    rng = np.random.default_rng(3)
    for k in (2, 3, 6):
        pairs = np.full((20, k, k), 0.5)
        for i in range(k):
            for j in range(i):
                pairs[:, i, j] = rng.uniform(0.01, 0.99, 20)
                pairs[:, j, i] = 1 - pairs[:, i, j]
        got = svm.coupled(pairs)
        assert np.allclose(got.sum(1), 1) and (got >= 0).all()

        def cost(p, r):
            return sum((r[j, i] * p[i] - r[i, j] * p[j]) ** 2 for i in range(k) for j in range(k) if i != j)

        for p, r in zip(got, pairs):
            for _ in range(30):
                other = np.abs(p + rng.normal(0, 0.01, k))
                assert cost(p, r) <= cost(other / other.sum(), r) + 1e-12
        if k == 2:
            assert np.allclose(got[:, 0], pairs[:, 0, 1])


def test_sigmoid_fits():
    rng = np.random.default_rng(4)
    m = rng.normal(0, 2, 4000)
    y = np.where(rng.random(4000) < 1 / (1 + np.exp(-1.5 * m + 0.5)), 1.0, -1.0)
    a, b = svm.sigmoid(m, y)
    assert abs(a + 1.5) < 0.15 and abs(b - 0.5) < 0.15
    assert np.isfinite(svm.sigmoid(np.array([1.0, 2.0, -1.0, -2.0]) * 1e6, np.array([1.0, 1, -1, -1]))).all()


@pytest.mark.parametrize("kernel", [svm.Kernel(), svm.Kernel("rbf", 0.5)])
def test_classes_of_held_out_rows(spark, kernel):
    rng = np.random.default_rng(5)
    centres = [[0, 0, 2], [2, 0, 0], [0, 2, 0]]
    x, y = blobs(rng, 240, centres)
    u, v = blobs(rng, 300, centres)
    model = svm.fit(table(spark, x, y), kernel)
    again = svm.fit(table(spark, x[::-1], y[::-1]).repartition(5), kernel)
    assert sorted(model.machines) == [(0, 1), (0, 2), (1, 2)] and np.allclose(model.probabilities(u), again.probabilities(u))
    got = {r["uid"]: r["scores"] for r in svm.classify(table(spark, u, v), model).collect()}
    p = np.array([[got[i][c] for c in model.labels] for i in range(len(u))])
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == v).mean() > 0.9
    # Probabilities are calibrated: the mean probability of the true class tells how often it is chosen.
    assert abs(p.max(1).mean() - (p.argmax(1) == v).mean()) < 0.08
    # Margins are those of a plain solution over the pair.
    s, w, b, *_ = model.machines[0, 1]
    pair = np.flatnonzero(y < 2)
    signs = np.where(y[pair] == 0, 1.0, -1.0)
    alpha, bias = svm.solve(kernel, x[pair], signs, np.ones(len(pair)), gap=1e-8)
    assert np.abs(kernel.of(u, s) @ w + b - (kernel.of(u, x[pair]) @ (alpha * signs) + bias)).max() < 0.02


def test_edges(spark):
    rows = spark.createDataFrame([(1, [0.0], "a"), (2, [1.0], "b"), (3, None, "a"), (4, [2.0], None), (1, [0.0], "a")], "uid bigint, vector array<double>, label string")
    model = svm.fit(rows, balanced=True)
    got = svm.classify(rows, model).collect()
    assert len(got) == 5 and [r["scores"] is None for r in got].count(True) == 1
    assert svm.classify(rows.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        svm.fit(rows.where("label = 'a'"))


def test_many_examples_in_little_memory(monkeypatch):
    """20,000 examples keep a bounded number of kernel rows: the whole matrix would take 3.2 GB, the tensor of minima 205 GB."""
    rng = np.random.default_rng(6)
    x, k = blobs(rng, 20_000, [[0.2] * 64, [0.8] * 64], 0.3)
    x, y = np.abs(x), np.where(k == 0, 1.0, -1.0)
    monkeypatch.setattr(svm, "CACHE_BYTES", 64 << 20)
    tracemalloc.start()
    alpha, bias = svm.solve(svm.Kernel("intersection"), x, y, np.ones(len(y)), rounds=60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20 and (alpha > 0).sum() > 10
    used = alpha > 0
    margins = svm.margin_of(svm.Kernel("intersection"), x[used], (alpha * y)[used])(x) + bias
    assert ((margins > 0) == (y > 0)).mean() > 0.9


def test_intersection_relevancy_scores_in_batches(spark):
    rng = np.random.default_rng(7)
    x, k = blobs(rng, 80, [[0.2] * 8, [0.9] * 8], 0.1)
    pool = table(spark, np.abs(x), k)
    out = learn.intersection_relevancy(pool.select("uid", "vector"), pool.where("label = 'c0'").select("uid", "vector").limit(5), pool.where("label = 'c1'").select("uid", "vector").limit(5))
    score = {r["uid"]: r["score"] for r in out.collect()}
    assert min(score[i] for i in range(80) if k[i] == 0) > max(score[i] for i in range(80) if k[i] == 1)
