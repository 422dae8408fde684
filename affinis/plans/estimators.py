"""Hash codes and classifiers as Spark ML estimators: fitted, saved and loaded like those, usable in pipelines."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from affinis.operators import hashing, learn


class TrainedError(RuntimeError):
    """A supervised classifier is trained once."""


class _Columns(Params):
    vectorCol = Param(Params._dummy(), "vectorCol", "array<double> column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the result", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "what was fitted, as JSON", TypeConverters.toString)


class Codes(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Iterative quantization, or random projection with ``functor`` ``random``."""

    bits = Param(Params._dummy(), "bits", "bits of a code", TypeConverters.toInt)
    functor = Param(Params._dummy(), "functor", "itq or random", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, vectorCol: str = "vector", outputCol: str = "code", bits: int = 8, functor: str = "itq", seed: int = 0):
        super().__init__()
        self._setDefault(vectorCol="vector", outputCol="code", bits=8, functor="itq", seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> CodesModel:
        rows = dataset.select(F.col(self.getOrDefault("vectorCol")).alias("vector")).where("vector is not null")
        bits, seed = self.getOrDefault("bits"), self.getOrDefault("seed")
        first = rows.first()
        if first is None:
            raise ValueError("codes are fitted on at least one vector")
        if self.getOrDefault("functor") == "itq":
            found = hashing.fit_itq(rows, bits, seed=seed)
        else:
            mean = [r["mean"] for r in hashing.mean_vector(rows).orderBy("pos").collect()]
            found = hashing.random_projection(len(first[0]), bits, seed, mean)
        model = CodesModel()
        model._set(vectorCol=self.getOrDefault("vectorCol"), outputCol=self.getOrDefault("outputCol"))
        return model._set(state=json.dumps({"matrix": found.matrix, "mean": found.mean, "order": found.order, "mean_first": found.mean_first}))


class CodesModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    @property
    def projection(self) -> hashing.Projection:
        return hashing.Projection(**json.loads(self.getOrDefault("state")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vector = F.col(self.getOrDefault("vectorCol"))
        return dataset.withColumn(self.getOrDefault("outputCol"), F.when(vector.isNotNull(), self.projection.code(vector)))


class LabelClassifier(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Logistic regression or linear machine; the model gives a map of scores by label."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "logistic or svm", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, vectorCol: str = "vector", outputCol: str = "scores", labelCol: str = "label", kind: str = "logistic"):
        super().__init__()
        self._setDefault(vectorCol="vector", outputCol="scores", labelCol="label", kind="logistic")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LabelModel:
        examples = dataset.select(F.col(self.getOrDefault("vectorCol")).alias("vector"), F.col(self.getOrDefault("labelCol")).alias("label"))
        found = {"logistic": learn.logistic, "svm": learn.linear_svm}[self.getOrDefault("kind")](examples)
        state = {"kind": self.getOrDefault("kind")} | {k: list(v) for k, v in vars(found).items()}
        return LabelModel()._set(vectorCol=self.getOrDefault("vectorCol"), outputCol=self.getOrDefault("outputCol"), state=json.dumps(state))


class LabelModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A trained classifier. ``train`` is for a model without a state; one that has a state refuses."""

    @property
    def labels(self) -> list[str]:
        return json.loads(self.getOrDefault("state"))["labels"]

    def train(self, examples: DataFrame, **given) -> LabelModel:
        if self.isDefined("state"):
            raise TrainedError("the classifier is trained already")
        fitted = LabelClassifier(**given).fit(examples)
        return self._set(**{p.name: fitted.getOrDefault(p) for p in fitted.params if fitted.isDefined(p)})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        state = json.loads(self.getOrDefault("state"))
        kind = state.pop("kind")
        model = (learn.LinearModel if kind == "logistic" else learn.MarginModel)(**state)
        vector = F.col(self.getOrDefault("vectorCol"))
        return dataset.withColumn(self.getOrDefault("outputCol"), F.when(vector.isNotNull(), model.scores(vector)))
