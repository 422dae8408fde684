"""Cutting lineage, sizing shuffles and what workers keep, the same way for all operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; where it names none, one that is set already, or in local mode a new temporary one."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="affinis-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``: later reads survive the loss of executors.

    The folder is the cluster's own (``spark.checkpoint.dir``); a temporary one is set only where
    that setting is missing, as in local tests.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], object]):
    """``make()``, which this Python worker keeps for later tasks of the same ``key``.

    Workers serve one stage after the other, so they keep one thing at a time; the pipeline's operators that keep nothing call ``forget``.
    """
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what this worker has kept for another operator, and Arrow's free memory."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def unit(*keys: str | Column) -> Column:
    """A number in [0, 1) from a hash of ``keys``; nulls count."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column: str, modulus: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``modulus``; null ids count as -1 (never held out)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % F.lit(modulus), F.lit(-1)).cast("int")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the checkpoint folder and read again."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def drawn(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """About ``rows`` rows of ``df``, drawn by a hash of ``keys``; at most twice as many, however many tasks there are."""
    total = max(1, df.count())
    return df.where(unit(*keys, F.lit("drawn")) < rows / total).limit(2 * rows)
