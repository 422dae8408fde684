"""Indexes as stored tables: Parquet partitioned by cell or code prefix beside the fitted model; searches read the partitions that they probe.

A folder holds ``model`` (one JSON line) and ``rows``, partitioned by ``part``. Each partition that an update touches is written anew, all others stay; a partition that loses
all its rows keeps one without an id. Updates of one index must not run at the same time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.functions import vec
from affinis.operators import hashing, ivf, knn, lsh
from affinis.operators.cutting import checkpoint_folder, cut

from .indexes import Index, Ivf, Lsh

#: Leading bits of a code by which its rows are stored.
PREFIX = 6


class StoredIndex:
    """A saved index: ``search``, ``update``, ``remove`` and ``count`` as those of the index in memory."""

    def __init__(self, spark: SparkSession, path: str, model: dict):
        self.spark, self.path, self.model = spark, path, model
        if model["kind"] == "lsh":
            self.projection = hashing.Projection(model["matrix"], model["mean"], model["order"], model["mean_first"])

    @property
    def rows(self) -> DataFrame:
        """``(uid, vector, part)``, with ``code`` for hash codes."""
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("uid").isNotNull())

    def parts_read(self, parts: list[int]) -> DataFrame:
        return self.rows.where(F.col("part").isin(parts))

    def count(self) -> int:
        return self.rows.count()

    def placed(self, rows: DataFrame) -> DataFrame:
        return placed(rows.select("uid", "vector"), self.model, getattr(self, "projection", None))

    def search(self, queries: DataFrame, n: int = 1, digits: int | None = None) -> DataFrame:
        """``(qid, uid, dist, rank)``, with distances rounded to ``digits`` before they are ranked. The parts asked for, at most as many as the model has, come to the driver, so that only they are read."""
        if not queries.where(F.col("qvector").isNull()).isEmpty():
            raise ValueError("a query has no vector")
        m = self.model
        if m["kind"] == "ivf":
            near = ivf.nearest_cells(queries.select("qid", "qvector"), "qvector", m["centroids"], m["probes"])
            parts = [r["part"] for r in near.select(F.explode("cells").alias("part")).distinct().collect()]
            rows = self.parts_read(parts).withColumn("cell", F.col("part"))
            if (found := ivf.in_blocks(rows, near, n, m["metric"], digits)) is not None:
                return found
            asked = cut(ivf.nearest_cells(queries.select("qid", "qvector"), "qvector", m["centroids"], m["probes"]).withColumn("part", F.explode("cells")).drop("cells"))
            on = ["part"]
        else:
            coded = queries.select("qid", "qvector").withColumn("qcode", self.projection.code(F.col("qvector")))
            codes = self.spark.read.parquet(f"{self.path}/rows").where(F.col("uid").isNotNull()).select("code")
            if (allowed := lsh.allowed(codes, coded, m["n_codes"] or n, m["bits"])) is not None:
                parts = sorted({int(c) >> max(0, m["bits"] - PREFIX) for c in allowed.any(axis=1).nonzero()[0]})
                if (found := lsh.in_blocks(self.parts_read(parts), coded, n, m["metric"], digits, allowed)) is not None:
                    return found
            near = lsh.nearest_codes(codes, coded, m["n_codes"] or n, m["bits"])
            asked = cut(near.select("qid", "code").join(queries.select("qid", "qvector"), "qid").withColumn("part", prefix(F.col("code"), m["bits"])))
            on = ["part", "code"]
        parts = [r["part"] for r in asked.select("part").distinct().collect()]
        dist = knn.metric(m["metric"])(F.col("vector"), F.col("qvector"))
        return knn.top(self.parts_read(parts).join(asked, on).select("qid", "uid", (F.round(dist, digits) if digits else dist).alias("dist")), n)

    def update(self, rows: DataFrame) -> StoredIndex:
        """Put ``(uid, vector)`` rows in, in place of those of their ids. Old places are found by reading the ids alone."""
        new = cut(self.placed(rows))
        old = self.rows.select("uid", "part").join(new.select("uid"), "uid", "left_semi")
        return self._rewrite([r["part"] for r in new.select("part").unionByName(old.select("part")).distinct().collect()], new.select("uid"), new)

    def remove(self, uids: DataFrame) -> StoredIndex:
        gone = cut(uids.select("uid").distinct())
        known = self.rows.select("uid", "part").join(gone, "uid", "left_semi")
        if known.select("uid").distinct().count() < gone.count():
            raise KeyError("an id is not in the index")
        return self._rewrite([r["part"] for r in known.select("part").distinct().collect()], gone, None)

    def _rewrite(self, parts: list[int], without: DataFrame, new: DataFrame | None) -> StoredIndex:
        if not parts:
            return self
        kept = self.parts_read(parts).join(without, "uid", "left_anti")
        kept = kept if new is None else kept.unionByName(new)
        # One row without an id for each part: an emptied part is written too.
        marks = self.spark.createDataFrame([(p,) for p in parts], "part int").select(*[F.lit(None).cast(t).alias(c) if c != "part" else F.col("part") for c, t in kept.dtypes])
        # What is read lies in what is written: it is kept apart first.
        cut(kept.unionByName(marks)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")
        return self


def prefix(code: Column, width: int) -> Column:
    """The ``PREFIX`` leading bits of a code; of a wide code, of its first word."""
    first, length = (code, width) if width <= 62 else (F.element_at(code, 1), 62)
    return F.shiftright(first, max(0, length - PREFIX)).cast("int")


def placed(rows: DataFrame, model: dict, projection: hashing.Projection | None) -> DataFrame:
    if model["kind"] == "ivf":
        return ivf.assign(rows, model["centroids"]).select("uid", "vector", F.col("cell").cast("int").alias("part"))
    return hashing.with_codes(rows, projection).withColumn("part", prefix(F.col("code"), model["bits"])).select("uid", "vector", "code", "part")


def save(index: Index, path: str) -> StoredIndex:
    """Write an ``Ivf`` (without reduction) or ``Lsh`` index to a new folder; fails if it is there."""
    if index.rows is None:
        raise knn.EmptyIndexError("the index is empty")
    spark = index.rows.sparkSession
    if isinstance(index, Ivf) and not index.axes:
        model, projection = {"kind": "ivf", "centroids": index.centroids, "probes": index.probes, "metric": index.metric}, None
    elif isinstance(index, Lsh):
        projection = index.projection
        model = {"kind": "lsh", "bits": index.bits, "n_codes": index.n_codes, "metric": index.metric, "matrix": projection.matrix, "mean": projection.mean, "order": projection.order, "mean_first": projection.mean_first}
    else:
        raise ValueError(f"{type(index).__name__} indexes are not stored")
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(f"{path}/model")
    rows = placed(index.rows.withColumn("vector", vec.doubles(F.col("vector"))), model, projection)
    # Rows of a part meet in a few tasks, a large part in several.
    rows.repartition("part", F.pmod(F.xxhash64("uid"), F.lit(8))).write.partitionBy("part").parquet(f"{path}/rows")
    return load(spark, path)


def new_folder(spark: SparkSession) -> str:
    """A folder that is not there yet, beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"


def load(spark: SparkSession, path: str) -> StoredIndex:
    return StoredIndex(spark, path, json.loads(spark.read.text(f"{path}/model").first()["value"]))
