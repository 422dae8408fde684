"""Classifiers, relevancy ranking and the histogram-intersection SVM.

Training sets of adjudications are small and on the driver as NumPy; pools are scored in place by expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis.functions import vec

from . import knn, svm

#: Most training examples that are brought to the driver.
MOST_EXAMPLES = 20_000


class LabelError(ValueError):
    pass


def index_label(rows: DataFrame, labels: list[str]) -> DataFrame:
    """``scores`` of the labels by place in the vector; fails on another width."""
    scores = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), "vector")
    return rows.withColumn("scores", F.when(F.size("vector") == len(labels), scores).otherwise(F.raise_error(F.lit("the vector is not as wide as the labels are many"))))


@dataclass
class LinearModel:
    """Scores ``softmax(weights x + bias)`` by label; for two labels this is the logistic function."""

    labels: list[str]
    weights: list[list[float]]
    bias: list[float]

    def scores(self, vector: Column) -> Column:
        raw = F.array(*[vec.dot(vector, knn.literal(w)) + F.lit(float(b)) for w, b in zip(self.weights, self.bias, strict=True)])

        def softmax(z: Column) -> Column:
            e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
            return F.transform(F.array(vec.total(e)), lambda s: F.transform(e, lambda x: x / s))[0]

        return F.map_from_arrays(F.array(*[F.lit(x) for x in self.labels]), F.transform(F.array(raw), softmax)[0])


def logistic(examples: DataFrame, c: float = 1.0, rounds: int = 100) -> LinearModel:
    """Logistic regression over ``(vector, label)`` with penalty ``1 / (c * n)``; needs two labels.

    The fit runs distributed, in Spark ML.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    named = examples.select(F.col("label").cast("string").alias("label"), array_to_vector("vector").alias("features")).cache()
    n, labels = named.count(), named.select("label").distinct().count()
    if labels < 2:
        raise LabelError("training needs at least two labels")
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(named)
    model = LogisticRegression(labelCol="y", standardization=False, elasticNetParam=0.0, regParam=1.0 / (c * n), maxIter=rounds, family="multinomial").fit(index.transform(named))
    named.unpersist()
    return LinearModel(list(index.labels), model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist())


@dataclass
class MarginModel:
    """Linear margins with a sigmoid for each label, ``1 / (1 + exp(slope * margin + offset))``, normalised over the labels."""

    labels: list[str]
    weights: list[list[float]]
    bias: list[float]
    sigmoids: list[tuple[float, float]]

    def margins(self, vector: Column) -> Column:
        return F.array(*[vec.dot(vector, knn.literal(w)) + F.lit(float(b)) for w, b in zip(self.weights, self.bias, strict=True)])

    def scores(self, vector: Column) -> Column:
        sigmoids = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in self.sigmoids])
        p = F.zip_with(self.margins(vector), sigmoids, lambda m, s: 1.0 / (1.0 + F.exp(s["a"] * m + s["b"])))
        shares = F.transform(F.array(p), lambda q: F.transform(q, lambda x: x / vec.total(q)))[0]
        return F.map_from_arrays(F.array(*[F.lit(x) for x in self.labels]), shares)


def linear_svm(examples: DataFrame, c: float = 1.0, rounds: int = 100, balanced: bool = True) -> MarginModel:
    """Linear support vector machine over ``(vector, label)``, one label against the rest; needs two labels.

    With ``balanced``, classes weigh by the geometric mean of their sizes over their own. The machines and the sigmoids of their margins are fitted in Spark ML, distributed.
    """
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    named = examples.select(F.col("label").cast("string").alias("label"), array_to_vector("vector").alias("features")).persist()
    sizes = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    if len(sizes) < 2:
        raise LabelError("training needs at least two labels")
    mean = float(np.exp(np.mean(np.log(list(sizes.values())))))
    weight = F.create_map(*[x for label, n in sizes.items() for x in (F.lit(label), F.lit(mean / n if balanced else 1.0))])
    weights, bias, sigmoids = [], [], []
    labels = sorted(sizes)
    for label in labels:
        two = named.select("features", (F.col("label") == label).cast("double").alias("y"), F.element_at(weight, F.col("label")).alias("w"))
        model = LinearSVC(labelCol="y", weightCol="w", regParam=1.0 / (c * sum(sizes.values())), maxIter=rounds, standardization=False).fit(two)
        scored = VectorAssembler(inputCols=["m"], outputCol="x").transform(model.transform(two).select(vector_element("rawPrediction", 1).alias("m"), "y"))
        curve = LogisticRegression(featuresCol="x", labelCol="y", standardization=False, maxIter=50).fit(scored)
        weights.append(model.coefficients.toArray().tolist())
        bias.append(float(model.intercept))
        sigmoids.append((-float(curve.coefficients[0]), -float(curve.intercept)))
    named.unpersist()
    return MarginModel(labels, weights, bias, sigmoids)


def vector_element(column: str, i: int) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)[i]


def adjusted_scores(scored: DataFrame, adjustment: dict[str, float], negate: bool = False) -> DataFrame:
    """``scores`` moved towards labels with a high ``adjustment``, or away from them with ``negate``; labels not named have 0."""
    sign = -1.0 if negate else 1.0
    known = F.create_map(*[x for label, a in adjustment.items() for x in (F.lit(label), F.lit(sign * a))]) if adjustment else F.create_map().cast("map<string,double>")
    keys, values = F.map_keys("scores"), F.map_values("scores")
    moved = vec.checked_adjustment(values, F.transform(keys, lambda k: F.coalesce(F.element_at(known, k), F.lit(0.0))))
    return scored.withColumn("scores", F.map_from_arrays(keys, moved))


def classify(rows: DataFrame, model: LinearModel) -> DataFrame:
    return rows.withColumn("scores", model.scores(F.col("vector")))


def classify_new(rows: DataFrame, done: DataFrame, model: LinearModel, overwrite: bool = False) -> DataFrame:
    """``done`` with the scores of the rows that it lacks, or of all on ``overwrite``; fails on a null vector."""
    todo = rows if overwrite else rows.join(done, "uid", "left_anti")
    vector = F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.raise_error(F.lit("a row has no vector")))
    new = todo.select("uid", model.scores(vector).alias("scores"))
    return new if overwrite else done.select("uid", "scores").unionByName(new)


def collection(rows: DataFrame, models: dict[str, LinearModel], wanted: list[str] | None = None) -> DataFrame:
    """``(classifier, uid, scores)`` for all classifiers or those ``wanted``; fails on an unknown one."""
    chosen = list(models) if wanted is None else wanted
    if gone := [x for x in chosen if x not in models]:
        raise LabelError(f"no such classifier: {gone}")
    named = F.array(*[F.struct(F.lit(x).alias("classifier"), models[x].scores(F.col("vector")).alias("scores")) for x in chosen])
    return rows.select("uid", F.inline(named)).select("classifier", "uid", "scores")


def with_label(scored: DataFrame, label: str) -> DataFrame:
    """Rows whose greatest score is ``label``'s."""
    from .evaluate import argmax_label

    return argmax_label(scored).where(F.col("label") == label)


def auto_negatives(positives: DataFrame, pool: DataFrame, ratio: int = 1, by: str = "hik") -> DataFrame:
    """Distinct uids of the ``ratio`` most distant pool rows of each positive; ties by uid."""
    far = knn.pairs(positives.select(F.col("uid").alias("qid"), F.col("vector").alias("qvector")), pool, by)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.col("dist").desc(), "uid"))
    return far.withColumn("rank", rank).where(F.col("rank") <= ratio).select("uid").distinct()


def _matrix(rows: DataFrame) -> np.ndarray:
    got = rows.limit(MOST_EXAMPLES + 1).collect()
    if len(got) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} examples")
    return np.array([r[0] for r in got], np.float64)


@dataclass
class KernelModel:
    """Dual solution with a sigmoid: support vectors, signed weights, bias and the sigmoid's slope and offset."""

    support: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    flipped: bool = False

    def scores(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(np.clip(self.slope * (svm.margin_of(INTERSECTION, self.support, self.weights)(x) + self.bias) + self.offset, -700, 700)))
        return 1 - p if self.flipped else p

    def scored(self, rows: DataFrame, key: str = "uid") -> DataFrame:
        """``(key, score)`` of ``rows (key, vector)``, by sorted support values in Arrow batches; null vectors have null scores."""
        shared, plain = rows.sparkSession.sparkContext.broadcast(self), rows.select(key, "vector")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = np.full(batch.num_rows, np.nan)
                there = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
                if there.any():
                    vectors = batch.column(1).filter(pa.array(there))
                    out[there] = shared.value.scores(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(there.sum()), -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, mask=~there)], [key, "score"])

        return plain.mapInArrow(run, f"{key} {dict(plain.dtypes)[key]}, score double")


INTERSECTION = svm.Kernel("intersection")


def fit_intersection_svm(positives: np.ndarray, negatives: np.ndarray, c: float = 2.0) -> KernelModel:
    """SVM with the histogram-intersection kernel; positives weigh ``max(1, negatives / positives)``."""
    x = np.concatenate([positives, negatives])
    y = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
    bound = np.where(y > 0, c * max(1.0, len(negatives) / len(positives)), c)
    alpha, bias = svm.solve(INTERSECTION, x, y, bound, gap=1e-6)
    keep = alpha > 1e-9
    support, weights = x[keep], (alpha * y)[keep]
    slope, offset = svm.sigmoid(svm.margin_of(INTERSECTION, support, weights)(x) + bias, y)
    return KernelModel(support, weights, bias, slope, offset)


def intersection_relevancy(pool: DataFrame, positives: DataFrame, negatives: DataFrame | None = None, c: float = 2.0) -> DataFrame:
    """``(uid, score)`` of the pool, from 0 to 1, higher for what is like the positives ``(uid, vector)``.

    Without negatives the pool's most distant rows are taken. If positives score below the pool's mean, scores are turned round.
    """
    if negatives is None or negatives.isEmpty():
        far = auto_negatives(positives, pool)
        negatives = pool.join(F.broadcast(far), "uid", "left_semi")
    own, other = _matrix(positives.select("vector")), _matrix(negatives.select("vector"))
    if not len(own) or not len(other):
        raise ValueError("positive and negative examples are needed")
    model = fit_intersection_svm(own, other, c)
    scored = model.scored(pool)
    mean = scored.agg(F.avg("score")).first()[0]
    likes = model.scored(positives.select(F.lit(0).alias("uid"), "vector")).agg(F.avg("score")).first()[0]
    if mean is not None and likes < mean:
        model.flipped = True
        scored = model.scored(pool)
    return scored


def margin_feedback(scored: DataFrame, n: int, centre: float = 0.5, digits: int | None = None) -> DataFrame:
    """The ``n`` rows whose score is nearest to ``centre``, to be labelled next; ties by uid."""
    gap = F.abs(F.col("score") - centre)
    return scored.withColumn("gap", F.round(gap, digits) if digits else gap).orderBy("gap", "uid").limit(n)


def quantise(features: DataFrame, codebook: list[list[float]], k: int = 1) -> DataFrame:
    """``(item, x, y, bin, rank)``: the ``k`` nearest codewords of each local feature ``vector``; ties by number.

    The codebook is broadcast, and Arrow batches are compared with it; distances that tie within rounding of the batch product are taken again by their definition.
    """
    shared = features.sparkSession.sparkContext.broadcast(np.array(codebook, np.float64))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        c = shared.value
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        n = min(k + 8, len(c))
        rough = (c**2).sum(1) - 2 * x @ c.T
        some = np.sort(np.argpartition(rough, n - 1, axis=1)[:, :n], 1) if n < len(c) else np.broadcast_to(np.arange(len(c)), rough.shape)
        exact = ((x[:, None] - c[some]) ** 2).sum(2)
        return pd.Series(list(np.take_along_axis(some, np.argsort(exact, 1, kind="stable")[:, :k], 1).astype(np.int32)))

    keep = [c for c in features.columns if c != "vector"]
    near = features.where(F.col("vector").isNotNull()).withColumn("_bins", nearest("vector"))
    return near.select(*keep, F.posexplode("_bins").alias("rank", "bin")).select(*keep, "bin", (F.col("rank") + 1).alias("rank"))


def clusters(rows: DataFrame, k: int, seed: int = 0, rounds: int = 20) -> DataFrame:
    """``(uid, cluster)`` by k-means; no rows give no clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if rows.isEmpty():
        return rows.select("uid", F.lit(0).alias("cluster"))
    data = rows.select("uid", array_to_vector("vector").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=rounds, predictionCol="cluster").fit(data).transform(data).select("uid", "cluster")
