import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.operators import evaluate, learn


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "uid bigint, vector array<double>")


def test_intersection_svm_against_another_solver():
    """The dual's optimum by projected gradient steps on random histograms: same objective, same margins."""
    rng = np.random.default_rng(11)
    x = rng.dirichlet(np.full(9, 0.7), 40)
    y = np.where(x[:, 0] + x[:, 1] > np.median(x[:, 0] + x[:, 1]), 1.0, -1.0)
    y[:3] *= -1
    own, other = x[y > 0], x[y < 0]
    model = learn.fit_intersection_svm(own, other, c=1.5)
    rows, y = np.concatenate([own, other]), np.concatenate([np.ones(len(own)), -np.ones(len(other))])
    kernel = np.minimum(rows[:, None], rows[None]).sum(2)
    q, bound = kernel * np.outer(y, y), np.where(y > 0, 1.5 * max(1.0, len(other) / len(own)), 1.5)

    def feasible(a):
        """Nearest point with ``0 <= a <= bound`` and ``y a = 0``."""
        low, high = -1e3, 1e3
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if y @ np.clip(a - mid * y, 0, bound) > 0 else (low, mid)
        return np.clip(a - (low + high) / 2 * y, 0, bound)

    alpha = np.zeros(len(y))
    for _ in range(20_000):
        alpha = feasible(alpha - (q @ alpha - 1) / np.linalg.eigvalsh(q)[-1])
    best = 0.5 * alpha @ q @ alpha - alpha.sum()
    weights = {tuple(s): w for s, w in zip(model.support.tolist(), model.weights.tolist(), strict=True)}
    found = np.array([weights.get(tuple(r), 0.0) for r in rows.tolist()]) * y
    assert 0.5 * found @ q @ found - found.sum() == pytest.approx(best, abs=1e-4)
    free = (alpha > 1e-4) & (alpha < bound - 1e-4)
    bias = (y - kernel @ (alpha * y))[free].mean()
    assert np.abs(kernel @ (found * y) + model.bias - (kernel @ (alpha * y) + bias)).max() < 0.02


def test_intersection_ranking(spark):
    """What shares most with the positives comes first, what shares with the negatives last."""
    pool = vectors(spark, [(0, [0.6, 0.4, 0, 0]), (1, [0.3, 0.3, 0.2, 0.2]), (2, [0, 0.1, 0.4, 0.5]), (3, [0.5, 0.5, 0, 0]), (4, [0, 0, 0.6, 0.4])])
    scored = learn.intersection_relevancy(pool, vectors(spark, [(90, [0.55, 0.45, 0, 0])]), vectors(spark, [(91, [0, 0, 0.5, 0.5])]))
    s = {r["uid"]: r["score"] for r in scored.collect()}
    assert min(s[0], s[3]) > s[1] > max(s[2], s[4]) and all(0 <= x <= 1 for x in s.values())
    assert learn.intersection_relevancy(pool, vectors(spark, [(90, [0.55, 0.45, 0, 0])])).count() == 5


def test_margin(spark):
    rows = spark.createDataFrame([(chr(97 + i), i * i / 100) for i in range(11)], "uid string, score double")
    pick = lambda c: [r["uid"] for r in learn.margin_feedback(rows, 2, c).collect()]
    assert pick(0.045) == ["c", "b"] and pick(0.2) == ["e", "f"]


def test_clusters(spark):
    rows = vectors(spark, [(i, np.eye(8)[i % 8]) for i in range(160)])
    got = learn.clusters(rows, 8).withColumn("kind", F.col("uid") % 8).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("kind").alias("k")).collect()
    assert len(got) == 8 and all(r["n"] == 20 and r["k"] == 1 for r in got)
    assert learn.clusters(rows.limit(0), 8).isEmpty()


def _examples(spark, seed, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3))
    y = np.where(x @ [1.5, -2.0, 0.5] + rng.normal(0, 0.7, n) > 0.3, "yes", "no")
    return x, y, spark.createDataFrame([(i, v.tolist(), str(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "uid bigint, vector array<double>, label string")


def test_logistic_against_newton(spark):
    x, y, data = _examples(spark, 4)
    model = learn.logistic(data, c=1.0)
    # Two labels with weights a and -a and penalty |a|^2 each are one logistic model of weight 2 a.
    z, t, beta = np.concatenate([x, np.ones((len(x), 1))], 1), (y == "yes").astype(float), np.zeros(4)
    ridge = np.diag([1.0, 1, 1, 0]) / (2 * len(x)) * len(x) / len(x)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(x) + ridge, z.T @ (p - t) / len(x) + ridge @ beta)
    got = [learn_p["p"] for learn_p in learn.classify(data, model).orderBy("uid").select(F.element_at("scores", "yes").alias("p")).collect()]
    assert np.abs(np.array(got) - 1 / (1 + np.exp(-z @ beta))).max() < 1e-3
    with pytest.raises(learn.LabelError):
        learn.logistic(data.where("label = 'yes'"))
    done = learn.classify(data.where("uid < 50"), model)
    assert learn.classify_new(data, done, model).count() == data.count()
    with pytest.raises(learn.LabelError):
        learn.collection(data, {"a": model}, ["b"])
    assert learn.collection(data, {"a": model, "b": model}).count() == 2 * data.count()


def test_linear_svm(spark):
    """Margins separate as the data allow, scores are probabilities that rise with the margin, and class weights count."""
    x, y, data = _examples(spark, 5)
    model = learn.linear_svm(data)
    rows = learn.classify(data, model).orderBy("uid").collect()
    p = np.array([r["scores"]["yes"] for r in rows])
    assert ((p > 0.5) == (y == "yes")).mean() > 0.88 and all(abs(sum(r["scores"].values()) - 1) < 1e-9 for r in rows)
    at = model.labels.index("yes")
    margin = x @ model.weights[at] + model.bias[at]
    assert (np.diff(p[np.argsort(margin)]) >= -0.02).all()
    # At the optimum no small step lowers the weighted hinge loss with its penalty.
    t, n = np.where(y == "yes", 1.0, -1.0), len(x)
    sizes = {k: (y == k).sum() for k in ("yes", "no")}
    w = np.array([np.sqrt(sizes["yes"] * sizes["no"]) / sizes[k] for k in y])
    loss = lambda v: (w * np.maximum(0, 1 - t * (x @ v[:3] + v[3]))).sum() / w.sum() + np.sum(v[:3] ** 2) / (2 * n)
    found = np.array([*model.weights[at], model.bias[at]])
    steps = np.random.default_rng(0).normal(0, 0.02, (200, 4))
    assert min(loss(found + s) for s in steps) > loss(found) - 1e-3
    with pytest.raises(learn.LabelError):
        learn.linear_svm(data.where("label = 'no'"))


def test_adjusted_scores(spark):
    rows = spark.createDataFrame([(1, {"a": 0.5, "b": 0.5})], "uid int, scores map<string,double>")
    up, down = (learn.adjusted_scores(rows, {"a": 1.0}, negate).first()["scores"]["a"] for negate in (False, True))
    assert up == pytest.approx(1 / (1 + np.exp(-1))) and down == pytest.approx(1 - up)
    assert learn.adjusted_scores(rows, {}).first()["scores"] == {"a": 0.5, "b": 0.5}


def test_index_label(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.9])], "uid int, vector array<double>")
    assert learn.index_label(rows, ["a", "b"]).first()["scores"] == {"a": 0.1, "b": 0.9}
    with pytest.raises(Exception, match="not as wide"):
        learn.index_label(rows, ["a"]).collect()


def test_curves(spark):
    rng = np.random.default_rng(3)
    rows = [(float(round(s, 1)), int(t)) for s, t in zip(rng.random(200), rng.integers(0, 2, 200), strict=True)]
    data = spark.createDataFrame(rows, "score double, truth int")
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    exact = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluate.roc_auc(data).first()[0] == pytest.approx(exact, abs=1e-6)
    curve = evaluate.roc_curve(data).orderBy("score").collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (1.0, 1.0)
    perfect = spark.createDataFrame([(0.9, 1), (0.1, 0)], "score double, truth int")
    assert evaluate.pr_auc(perfect).first()[0] == 1.0


def test_pooling_defaults(spark):
    members = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("a", 2, 0.9)], "grp string, item int, score double")
    parents = spark.createDataFrame([("a",), ("b",)], "grp string")
    got = {r["grp"]: (r["max_score"], r["avg_score"]) for r in evaluate.pooled(members, "item", "grp", default=0.5, parents=parents).collect()}
    assert got == {"a": (0.9, 0.6), "b": (0.5, 0.5)}
    with pytest.raises(ValueError):
        evaluate.pooled_available(members.withColumnRenamed("item", "uid"), members.select(F.lit(99).alias("uid")), "grp")
