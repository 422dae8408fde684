"""Relevancy indexes: built over a pool once, ranked by examples as often as wanted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from affinis.operators import learn, sets, svm

from .registry import Registry

RELEVANCY = Registry("relevancy")


class NotBuiltError(RuntimeError):
    """A relevancy index ranks only what it was built over."""


class RelevancyIndex:
    """A pool ``(uid, vector)``; ``rank`` gives ``(uid, score)`` of all of it, from 0 to 1."""

    def __init__(self):
        self.rows: DataFrame | None = None

    def count(self) -> int:
        return 0 if self.rows is None else self.rows.count()

    def build(self, rows: DataFrame) -> RelevancyIndex:
        if rows.isEmpty():
            raise ValueError("a relevancy index needs at least one row")
        self.rows = rows.select("uid", "vector")
        return self

    def update(self, rows: DataFrame) -> RelevancyIndex:
        return self.build(rows if self.rows is None else sets.upsert(self.rows, rows.select("uid", "vector"), "uid"))

    def rank(self, positives: DataFrame, negatives: DataFrame) -> DataFrame:
        """Scores by examples ``(vector)``; both kinds are needed."""
        if self.rows is None:
            raise NotBuiltError("the relevancy index is not built")
        if positives.isEmpty() or negatives.isEmpty():
            raise ValueError("positive and negative examples are needed")
        return self._rank(positives.select("vector"), negatives.select("vector"))

    def _rank(self, positives: DataFrame, negatives: DataFrame) -> DataFrame:
        raise NotImplementedError


@RELEVANCY.add(name="intersection")
class IntersectionRelevancy(RelevancyIndex):
    """Machines with the histogram-intersection kernel."""

    def __init__(self, c: float = 2.0):
        super().__init__()
        self.c = c

    def _rank(self, positives, negatives):
        return learn.intersection_relevancy(self.rows, positives, negatives, self.c)


@RELEVANCY.add(name="classifier")
class ClassifierRelevancy(RelevancyIndex):
    """A new classifier for each ranking: ``logistic`` regression, or a machine of a ``kernel``. The score is the probability of the positives."""

    def __init__(self, kind: str = "logistic", c: float = 1.0):
        super().__init__()
        fits: dict[str, Callable] = {"logistic": lambda e: learn.logistic(e, c)} | {k: lambda e, k=k: svm.fit(e, svm.Kernel(k), c) for k in ("linear", "rbf", "poly", "intersection")}
        if kind not in fits:
            raise ValueError(f"kind must be one of {sorted(fits)}")
        self.kind, self.c, self.fit = kind, c, fits[kind]

    def _rank(self, positives, negatives):
        model = self.fit(positives.withColumn("label", F.lit("pos")).unionByName(negatives.withColumn("label", F.lit("neg"))))
        scored = learn.classify(self.rows, model) if self.kind == "logistic" else svm.classify(self.rows, model)
        return scored.select("uid", F.element_at("scores", "pos").alias("score"))
