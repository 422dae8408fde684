"""Maintaining tables batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery


def since(rows: DataFrame, mark: Column | str, upto: Column | str, column: str = "ts") -> DataFrame:
    """Rows after a high-water mark, up to and including ``upto``."""
    at = lambda x: F.lit(x).cast("timestamp") if isinstance(x, str) else x
    return rows.where((F.col(column).cast("timestamp") > at(mark)) & (F.col(column).cast("timestamp") <= at(upto)))


def merged(index: DataFrame, batch: DataFrame, key: str = "uid") -> DataFrame:
    """``index`` with the last row that ``batch`` has for each key."""
    return index.join(batch, key, "left_anti").unionByName(batch)


class VersionedTable:
    """A table of which each merge writes a new version, named in the folder's newest entry; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm

    def versions(self) -> list[int]:
        fs, root, jvm = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self, schema=None) -> DataFrame:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, version: int, key: str = "uid") -> None:
        """Version ``version`` from the one before it; a repeated batch writes the same version again."""
        earlier = [v for v in self.versions() if v < version]
        base = self.spark.read.parquet(f"{self.path}/v{earlier[-1]}") if earlier else batch.limit(0)
        merged(base, batch, key).write.mode("overwrite").parquet(f"{self.path}/v{version}")


def maintain(stream: DataFrame, table: VersionedTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, key: str = "uid", **trigger) -> StreamingQuery:
    """Merges every micro-batch of ``stream`` into ``table``: only new rows are prepared (hashed, described)."""
    return stream.writeStream.foreachBatch(lambda batch, n: table.merge(prepare(batch), n, key)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sessions(events: DataFrame, timeout: str, user: str = "user_id", column: str = "ts", watermark: str | None = None) -> DataFrame:
    """``(user, start, last, n)`` of the sessions that end by idling for longer than ``timeout``; for tables and, with a watermark, for streams."""
    rows = events.withColumn(column, F.col(column).cast("timestamp"))
    rows = rows.withWatermark(column, watermark) if watermark else rows
    found = rows.groupBy(user, F.session_window(column, timeout)).agg(F.min(column).alias("start"), F.max(column).alias("last"), F.count(F.lit(1)).alias("n"))
    return found.drop("session_window")


def cache_hits(accesses: DataFrame, timeout: float, key: str = "key", column: str = "ts") -> DataFrame:
    """``hit`` for each access: whether the entry was there, that is used less than ``timeout`` seconds before; 0 never expires."""
    gap = F.col(column).cast("timestamp").cast("double") - F.lag(F.col(column).cast("timestamp").cast("double")).over(W.partitionBy(key).orderBy(column))
    hit = gap.isNotNull() if timeout == 0 else F.coalesce(gap < timeout, F.lit(False))
    return accesses.withColumn("hit", hit)


def latest_with_expiry(stream: DataFrame, key: str, timeout_ms: int) -> DataFrame:
    """Streaming cache: the last value of each key, and a row with null when it has idled for ``timeout_ms``.

    ``stream`` has ``key`` and ``value`` strings. State is kept by key with a processing-time timer.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [keys[0]], "value": [None], "expired": [True]})
            return
        value = None
        for batch in batches:
            value = batch["value"].iloc[-1]
        state.update((value,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"key": [keys[0]], "value": [value], "expired": [False]})

    return stream.groupBy(key).applyInPandasWithState(step, "key string, value string, expired boolean", "value string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def step_centroids(centroids: list[list[float]], counts: list[float], batch: DataFrame) -> tuple[list[list[float]], list[float]]:
    """Mini-batch k-means: centroids move by the batch's means, weighted with the counts so far."""
    from affinis.functions import vec
    from affinis.operators import ivf

    d = len(centroids[0])
    sums = ivf.assign(batch, centroids).select("cell", F.posexplode(vec.doubles(F.col("vector"))).alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    new, seen = [list(c) for c in centroids], list(counts)
    for cell in {r["cell"] for r in sums}:
        own = {r["i"]: r for r in sums if r["cell"] == cell}
        n = own[0]["n"]
        for i in range(d):
            new[cell][i] = (centroids[cell][i] * counts[cell] + own[i]["s"]) / (counts[cell] + n)
        seen[cell] = counts[cell] + n
    return new, seen


def start_memory(stream: DataFrame, mode: str = "append") -> tuple[StreamingQuery, str]:
    """Runs all that is available into a named in-memory table, for tests and inspection."""
    name = f"t{uuid.uuid4().hex}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, name


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows so far and rows a second of a query's last and all batches."""
    all_ = query.recentProgress
    rows = sum(p["numInputRows"] for p in all_)
    seconds = sum(p.get("durationMs", {}).get("triggerExecution", 0) for p in all_) / 1000
    last = all_[-1] if all_ else None
    return {"rows": rows, "rate": rows / seconds if seconds else 0.0, "last_rate": float(last["processedRowsPerSecond"] or 0) if last else 0.0}
