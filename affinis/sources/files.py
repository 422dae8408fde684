"""File trees, vector text formats and Parquet layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from affinis.functions import text


def contents(spark: SparkSession, path: str, glob: str | None = None, pattern: str | None = None, depth: bool = True) -> DataFrame:
    """``(uid, path, content, content_type, modified, size)`` of the files under ``path``; the uid is the content's SHA-1.

    ``glob`` is applied to file names by the reader, ``pattern`` to whole paths. Spark's reader leaves empty files out, as empty elements are.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", depth)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    raw = raw.where(F.col("path").rlike(pattern)) if pattern else raw
    return raw.select(F.sha1("content").alias("uid"), "path", "content", text.content_type(F.col("path")).alias("content_type"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def data_set(elements: DataFrame) -> DataFrame:
    """Elements, one for each uid."""
    return elements.dropDuplicates(["uid"])


def of_type(elements: DataFrame, types: list[str], strict: bool = False) -> DataFrame:
    """Elements of the given content types; ``strict`` fails on any other."""
    fits = F.coalesce(F.col("content_type").isin(types), F.lit(False))
    if strict:
        return elements.where(F.when(fits, True).otherwise(F.raise_error(F.lit("content type is not among the valid ones"))))
    return elements.where(fits)


def memory_elements(uris: DataFrame) -> DataFrame:
    """``(uid, content, content_type)`` of ``base64://`` and ``data:`` URIs."""
    uri = F.col("uri")
    code = F.when(uri.startswith("base64://"), F.substring(uri, 10, 1 << 30)).otherwise(F.regexp_extract(uri, "(?s)^data:[^,]*;base64,(.*)$", 1))
    content = text.from_base64_url(code)
    kind = F.when(uri.startswith("data:"), F.regexp_extract(uri, "^data:([^;,]*)", 1))
    return uris.select(F.sha1(content).alias("uid"), content.alias("content"), kind.alias("content_type"))


def older_than(files: DataFrame, seconds: float, now: Column | None = None) -> DataFrame:
    """Files whose last change is more than ``seconds`` ago."""
    return files.where((now if now is not None else F.current_timestamp()).cast("double") - F.col("modified").cast("double") > seconds)


def libsvm_lines(rows: DataFrame, digits: int | None = None) -> DataFrame:
    """``(uid, value)`` with lines ``label index:value``: indices from 1, zeros left out, labels as numbers in the order of their least uid.

    Values have the fewest digits that are read back as the same number, or ``digits`` behind the point.
    """
    written = lambda x: x.cast("string") if digits is None else F.format_string(f"%.{digits}f", x)
    first = rows.groupBy("label").agg(F.min("uid").alias("first"))
    from pyspark.sql import Window as W

    numbers = first.withColumn("number", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("first"))).drop("first")  # one row per label
    cells = F.filter(F.transform("vector", lambda x, i: F.when(x != 0, F.concat((i + 1).cast("string"), F.lit(":"), written(x)))), lambda s: s.isNotNull())
    return rows.join(F.broadcast(numbers), "label").select("uid", F.concat_ws(" ", F.col("number").cast("string"), F.concat_ws(" ", cells)).alias("value"))


def write_libsvm(rows: DataFrame, path: str) -> None:
    libsvm_lines(rows).select("value").write.text(path)


def parse_libsvm(lines: DataFrame, width: int, first: int = 1, labelled: bool = True) -> DataFrame:
    """``lines (value, ...)`` with ``label`` and dense ``vector``; indices start at ``first``."""
    tokens = F.split(F.trim("value"), r"\s+")
    cells = F.slice(tokens, 2, F.size(tokens)) if labelled else tokens
    known = F.map_from_entries(F.transform(F.filter(cells, lambda c: c.contains(":")), lambda c: F.struct(F.split_part(c, F.lit(":"), F.lit(1)).cast("int").alias("i"), F.split_part(c, F.lit(":"), F.lit(2)).cast("double").alias("x"))))
    dense = F.transform(F.array(known), lambda m: F.transform(F.sequence(F.lit(first), F.lit(first + width - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0))))[0]
    out = lines.withColumn("vector", dense)
    return out.withColumn("label", tokens[0]) if labelled else out


def read_libsvm(spark: SparkSession, path: str, width: int, first: int = 1, labelled: bool = True) -> DataFrame:
    return parse_libsvm(spark.read.text(path), width, first, labelled).drop("value")


def parse_csv_vectors(lines: DataFrame) -> DataFrame:
    return lines.withColumn("vector", F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double")))


def read_csv_vectors(spark: SparkSession, path: str) -> DataFrame:
    return parse_csv_vectors(spark.read.text(path)).drop("value")


def write_sharded(elements: DataFrame, path: str, characters: int = 2, mode: str = "overwrite") -> None:
    """Parquet in folders by the beginning of the uid, so that point look-ups read one of them."""
    elements.withColumn("shard", F.substring("uid", 1, characters)).write.mode(mode).partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, uids: list[str], characters: int = 2) -> DataFrame:
    return spark.read.parquet(path).where(F.col("shard").isin(sorted({u[:characters] for u in uids})) & F.col("uid").isin(uids)).drop("shard")


def write_vectors(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Matrices and vectors as Parquet, which replaces files by commit, never half written."""
    rows.write.mode(mode).parquet(path)


def frame_times(start: float, stop: float, interval: float) -> list[float]:
    """Times of frames from an offset to an end, for an external frame extractor."""
    n = int((stop - start) / interval + 1e-9)
    return [start + i * interval for i in range(n + 1)]
