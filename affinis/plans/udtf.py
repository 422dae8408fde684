"""Table functions for SQL: their arguments are tables, dealt by the caller's keys."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf
class Nearest:
    """``nearest(TABLE(pairs), n)``: of ``pairs (qid, uid, dist)`` the ``n`` nearest of each ``qid``, with ``rank``; ties by uid.

    Rows are dealt by ``qid`` and sorted by Spark; the function keeps a counter alone.
    """

    @staticmethod
    def analyze(pairs: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not pairs.isTable or [c for c in ("qid", "uid", "dist") if c not in pairs.dataType.names]:
            raise ValueError("the first argument must be a table with qid, uid and dist")
        if n.value is None or n.value < 1:
            raise ValueError("n must be a constant of at least 1")
        fields = [pairs.dataType[c] for c in ("qid", "uid", "dist")]
        return AnalyzeResult(StructType([*fields, StructField("rank", IntegerType())]), partitionBy=[PartitioningColumn("qid")], orderBy=[OrderingColumn("dist"), OrderingColumn("uid")])

    def __init__(self):
        self.rank = 0

    def eval(self, pairs: Row, n: int) -> Iterator[tuple]:
        self.rank += 1
        if self.rank <= n:
            yield pairs["qid"], pairs["uid"], pairs["dist"], self.rank


@udtf
class Tiles:
    """``tiles(TABLE(images), w, h)``: of ``images (uid, width, height)`` every tile of ``w`` by ``h`` that lies inside: ``(uid, left, top)``."""

    @staticmethod
    def analyze(images: AnalyzeArgument, w: AnalyzeArgument, h: AnalyzeArgument) -> AnalyzeResult:
        if min(w.value or 0, h.value or 0) < 1:
            raise ValueError("tiles must be at least 1 by 1")
        return AnalyzeResult(StructType([images.dataType["uid"], StructField("left", IntegerType()), StructField("top", IntegerType())]))

    def eval(self, images: Row, w: int, h: int) -> Iterator[tuple]:
        for x in range(0, (images["width"] or 0) - w + 1, w):
            for y in range(0, (images["height"] or 0) - h + 1, h):
                yield images["uid"], x, y


def register(spark: SparkSession) -> None:
    spark.udtf.register("nearest", Nearest)
    spark.udtf.register("tiles", Tiles)
