"""URL allow and block rules by a sort-merge range join.

A rule's host becomes a reversed, dot-terminated key (``org.example.``), so that a host and its
subdomains are one interval of keys. URLs and rules are dealt to ranges of that order; in each range a
sorted sweep keeps the stack of rule hosts whose intervals are open and takes the longest rule whose
path begins the URL's path.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import drawn

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts after every character of a host.
_END = "\U0010ffff"
#: Keys drawn to choose the ranges' bounds; they place rows only and can't change results.
SAMPLE = 20_000

DEFAULT_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit(".")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``(verdict, rule)`` pairs as a table; a rule is ``host/path-prefix``."""
    return spark.createDataFrame(rules, "verdict string, rule string")


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        spot = None
        for batch in batches:
            out = []
            rows = batch.to_pydict()
            for part, key, verdict, rule, page, host, path in zip(*(rows[c] for c in ("part", "key", "verdict", "rule", "page", "host", "path")), strict=True):
                if part != spot:
                    stack, spot = [], part
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rule is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    stack[-1][1][path] = (rule, verdict)
                    if len(path) not in stack[-1][2]:
                        stack[-1][2].append(len(path))
                        stack[-1][2].sort(reverse=True)
                    continue
                best = None
                for _, paths, lengths in stack:
                    found = next((paths[path[:n]] for n in lengths if path[:n] in paths), None)
                    if found and (best is None or len(found[0]) > len(best[0])):
                        best = found
                out.append((page, host, path, *(best or (None, default))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i == 0 else pa.string()) for i in range(5)], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row for each row of ``pages``.

    ``rules`` has ``verdict`` and ``rule`` (``host/path-prefix``). A rule fits its host and all subdomains if the
    path starts with the rule's; of several the longest rule wins, of equal ones the verdict that sorts first. Where none fits, rule is
    null and the verdict ``default``.

    A null URL or one without ``://`` has an empty host and path. Null ids stay null, repeated rows are judged each,
    rules with null fields are ignored. A very common key is dealt to several ranges, each of which gets
    the rules that are open there.
    """
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    urls = pages.select(F.col(id_column).cast("bigint").alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.withColumn("key", reversed_key(F.col("host")))
    text = F.col("rule").cast("string")
    hosts = F.translate(F.regexp_extract(text, r"(?s)^([^/]*)", 1), _UPPER, _LOWER)
    known = rules.where(F.col("verdict").isNotNull() & text.isNotNull()).groupBy(text.alias("rule")).agg(F.min("verdict").alias("verdict"))
    known = known.select("rule", "verdict", reversed_key(hosts).alias("key"), F.regexp_extract(text, r"(?s)^[^/]*(.*)", 1).alias("path")).where("key <> ''")

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.concat("key", F.lit(" "), "path")
    sample = sorted(r[0] for r in drawn(urls.select("page", order.alias("order")), SAMPLE, "page", "order").select("order").collect())
    bounds = [sample[i * len(sample) // width] for i in range(1, width)] if sample else []

    @F.pandas_udf("array<int>")
    def ranges(low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([[bisect_left(bounds, a), bisect_right(bounds, b)] for a, b in zip(low, high, strict=True)])

    # A URL whose order is a bound itself may go to either side, by its id: so copies are spread.
    spot = F.col("r")[0] + F.pmod(F.xxhash64("page", "path"), F.col("r")[1] - F.col("r")[0] + 1).cast("int")
    dealt = urls.withColumn("r", ranges(order, order)).select(spot.alias("part"), "key", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"), "page", "host", "path", F.lit(1).alias("kind"))
    opened = known.withColumn("r", ranges(F.col("key"), F.concat("key", F.lit(_END)))).select(F.explode(F.sequence(F.col("r")[0], F.col("r")[1])).alias("part"), "key", "verdict", "rule", F.lit(None).cast("bigint").alias("page"), F.lit(None).cast("string").alias("host"), "path", F.lit(0).alias("kind"))
    sorted_rows = dealt.unionByName(opened).repartition(width, "part").sortWithinPartitions("part", "key", "kind")
    return sorted_rows.mapInArrow(_sweep(default), "page_id bigint, host string, path string, rule string, verdict string").withColumnRenamed("page_id", id_column)
