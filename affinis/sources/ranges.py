"""Scans of a key space range by range, which go on where they were stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def key_ranges(keys: DataFrame, parts: int, key: str = "key") -> list[tuple]:
    """At most ``parts`` half-open ranges ``(low, high)`` of about equally many numeric keys; the first and last are open-ended (None)."""
    bounds = keys.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    cuts = sorted(set(bounds or []))
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def within(rows: DataFrame, low, high, key: str = "key") -> DataFrame:
    """Rows with ``low <= key < high``; a filter that sources can take over. Null keys are in the first range."""
    if low is None:
        return rows if high is None else rows.where(F.col(key).isNull() | (F.col(key) < high))
    return rows.where(F.col(key) >= low) if high is None else rows.where((F.col(key) >= low) & (F.col(key) < high))


def scan(spark: SparkSession, rows: DataFrame, ranges: list[tuple], path: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, key: str = "key") -> int:
    """Writes ``prepare(rows)`` of each range to a folder of its own under ``path``; ranges that are there whole are passed over.

    Gives the number of ranges written. ``read`` reads them together.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for i, (low, high) in enumerate(ranges):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/range={i:06d}")
        if not folder.getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            prepare(within(rows, low, high, key)).write.mode("overwrite").parquet(folder.toString())
            done += 1
    return done


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("range")
