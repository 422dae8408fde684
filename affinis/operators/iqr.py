"""Interactive query refinement: sessions, working sets, refinement and views of results.

A session's adjudications are a small table ``(uid, role)`` with roles ``pos``, ``neg``, ``ext_pos`` and ``ext_neg``;
working sets and results stay distributed.
"""

from __future__ import annotations

import uuid as uuids
from dataclasses import dataclass, field
from time import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import knn, learn

_STATE = "role string, uid string, vector array<double>"


def working_set(positives: DataFrame, pool: DataFrame, neighbours: int, by: str = "euclidean", digits: int | None = None) -> DataFrame:
    """Distinct uids of the nearest pool rows of all ``positives (qid, qvector)``."""
    return knn.nearest_batch(positives, pool, neighbours, by, digits).select("uid").distinct()


@dataclass
class Session:
    """One user's search over ``pool (uid, vector)``."""

    pool: DataFrame
    neighbours: int = 10
    by: str = "euclidean"
    id: str = field(default_factory=lambda: uuids.uuid4().hex)
    positive: set = field(default_factory=set)
    negative: set = field(default_factory=set)
    external_positive: dict = field(default_factory=dict)
    external_negative: dict = field(default_factory=dict)
    seeds_used: set = field(default_factory=set)
    working: DataFrame | None = None
    results: DataFrame | None = None
    feedback: DataFrame | None = None
    version: int = 0

    def _set(self, uids) -> DataFrame:
        spark = self.pool.sparkSession
        kind = self.pool.schema["uid"].dataType.simpleString()
        return spark.createDataFrame([(u,) for u in uids], f"uid {kind}")

    def adjudicate(self, new_pos=(), new_neg=(), un_pos=(), un_neg=()) -> None:
        """Positives and negatives of the pool; an item named for both ends in neither. Results that no longer hold are dropped."""
        new_pos, new_neg = set(new_pos), set(new_neg)
        before = (set(self.positive), set(self.negative))
        self.positive = ((self.positive | new_pos) - set(un_pos)) - new_neg
        self.negative = ((self.negative | new_neg) - set(un_neg)) - new_pos
        if before != (self.positive, self.negative):
            self.version += 1

    def external(self, positive: dict | None = None, negative: dict | None = None) -> None:
        """Examples from outside the pool, uid to vector; the newer side wins."""
        positive, negative = positive or {}, negative or {}
        self.external_positive = {u: v for u, v in (self.external_positive | positive).items() if u not in negative}
        self.external_negative = {u: v for u, v in (self.external_negative | negative).items() if u not in positive}
        self.version += 1

    def examples(self, positive: bool) -> DataFrame:
        """``(uid, vector)`` of one side, inside and outside the pool."""
        inside, outside = (self.positive, self.external_positive) if positive else (self.negative, self.external_negative)
        out = self.pool.join(F.broadcast(self._set(inside)), "uid", "left_semi").select("uid", "vector")
        if not outside:
            return out
        kind = self.pool.schema["uid"].dataType.simpleString()
        return out.unionByName(self.pool.sparkSession.createDataFrame(list(outside.items()), f"uid {kind}, vector array<double>"))

    def update_working_set(self) -> DataFrame:
        """Adds the neighbours of every positive that hasn't served yet."""
        seeds = {("in", u) for u in self.positive} | {("ext", u) for u in self.external_positive}
        if new := seeds - self.seeds_used:
            ids = {u for _, u in new}
            asked = self.examples(True).where(F.col("uid").isin(list(ids))).select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))
            near = working_set(asked, self.pool, self.neighbours, self.by)
            self.working = near if self.working is None else self.working.unionByName(near).distinct()
            self.seeds_used |= new
        if self.working is None:
            raise ValueError("there are no positive examples")
        return self.working

    def refine(self, ranker=None, feedback: int = 10) -> DataFrame:
        """``(uid, score)`` of the working set, and the items to label next. Histogram-intersection ranking by default."""
        if self.working is None:
            raise ValueError("the working set is empty")
        pool = self.pool.join(self.working, "uid", "left_semi").select("uid", "vector")
        ranker = ranker or learn.intersection_relevancy
        if self.results is not None:
            self.results.unpersist()
        self.results = ranker(pool, self.examples(True), self.examples(False)).persist()
        self.feedback = learn.margin_feedback(self.results, feedback)
        return self.results

    def ordered(self) -> DataFrame:
        return self.results.orderBy(F.col("score").desc(), "uid")

    def view(self, which: str) -> DataFrame:
        """``positive``, ``negative`` or ``unadjudicated`` results, in order."""
        sides = {"positive": self.positive, "negative": self.negative, "unadjudicated": self.positive | self.negative}
        how = "left_anti" if which == "unadjudicated" else "left_semi"
        return self.ordered().join(F.broadcast(self._set(sides[which])), "uid", how).orderBy(F.col("score").desc(), "uid")

    def state(self) -> DataFrame:
        """All examples with their roles, to be written and restored."""
        spark = self.pool.sparkSession
        inside = [("pos", self.positive), ("neg", self.negative)]
        out = spark.createDataFrame([], _STATE)
        for role, uids in inside:
            out = out.unionByName(self.pool.join(F.broadcast(self._set(uids)), "uid", "left_semi").select(F.lit(role).alias("role"), F.col("uid").cast("string").alias("uid"), "vector"))
        rows = [(r, str(u), list(map(float, v))) for r, side in (("ext_pos", self.external_positive), ("ext_neg", self.external_negative)) for u, v in side.items()]
        return out.unionByName(spark.createDataFrame(rows, _STATE))

    def restore(self, state: DataFrame) -> None:
        """Sets the examples of ``state``; fails if the pool has another vector for one of its items."""
        kind = self.pool.schema["uid"].dataType.simpleString()
        rows = state.select("role", F.col("uid").cast(kind).alias("uid"), "vector")
        inside = rows.where(F.col("role").isin("pos", "neg"))
        known = inside.join(self.pool.select("uid", F.col("vector").alias("own")), "uid", "left")
        if not known.where(F.col("own").isNull() | (F.col("own") != F.col("vector"))).isEmpty():
            raise ValueError("the state's vectors are not the pool's")
        got = rows.collect()
        pick = lambda role: [(r["uid"], r["vector"]) for r in got if r["role"] == role]
        self.positive, self.negative = {u for u, _ in pick("pos")}, {u for u, _ in pick("neg")}
        self.external_positive, self.external_negative = dict(pick("ext_pos")), dict(pick("ext_neg"))
        if self.results is not None:
            self.results.unpersist()
        self.working = self.results = self.feedback = None
        self.seeds_used, self.version = set(), self.version + 1


class Controller:
    """Sessions by id; those idle for longer than ``timeout`` seconds are let go."""

    def __init__(self, timeout: float = 3600, clock=time):
        self.timeout, self.clock = timeout, clock
        self.sessions: dict[str, tuple[Session, float]] = {}

    def add(self, session: Session) -> str:
        if session.id in self.sessions:
            raise KeyError(session.id)
        self.sessions[session.id] = (session, self.clock())
        return session.id

    def get(self, sid: str) -> Session:
        self.expire()
        session = self.sessions[sid][0]
        self.sessions[sid] = (session, self.clock())
        return session

    def expire(self, done=lambda session: None) -> list[str]:
        gone = [sid for sid, (_, seen) in self.sessions.items() if self.clock() - seen > self.timeout]
        for sid in gone:
            done(self.sessions.pop(sid)[0])
        return gone


def train_from_state(state: DataFrame) -> learn.LinearModel:
    """Classifier with labels ``positive`` and ``negative`` from a session's state."""
    return learn.logistic(state.select("vector", F.when(F.col("role").isin("pos", "ext_pos"), "positive").otherwise("negative").alias("label")))


def new_session(spark: SparkSession, pool: DataFrame, **settings) -> Session:
    return Session(pool, **settings)
