import os
import time

import pytest
from pyspark.sql import functions as F

from affinis.sources import files
from affinis.streaming import incremental


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(b"123")
    (tmp_path / "y.txt").write_bytes(b"123")
    (tmp_path / "z.txt").write_bytes(b"")
    found = files.contents(spark, str(tmp_path))
    assert found.count() == 2 and files.data_set(found).count() == 1
    assert files.of_type(found, ["image/png"]).count() == 1
    with pytest.raises(Exception, match="content type"):
        files.of_type(found, ["image/png"], strict=True).collect()
    assert files.contents(spark, str(tmp_path), glob="*.txt").count() == 1
    os.utime(tmp_path / "y.txt", (time.time() - 1000,) * 2)
    assert files.older_than(files.contents(spark, str(tmp_path)), 500).count() == 1
    files.write_sharded(found.select("uid", "content"), str(tmp_path / "out"))
    uid = found.first()["uid"]
    assert {r["uid"] for r in files.read_shard(spark, str(tmp_path / "out"), [uid]).collect()} == {uid}


def test_libsvm_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", [0.0, 1.5]), (2, "a", [2.0, 0.0])], "uid int, label string, vector array<double>")
    files.write_libsvm(rows, str(tmp_path / "t"))
    got = {(r["label"], tuple(r["vector"])) for r in files.read_libsvm(spark, str(tmp_path / "t"), 2).collect()}
    assert got == {("1", (0.0, 1.5)), ("2", (2.0, 0.0))}
    plain = files.parse_libsvm(spark.createDataFrame([("0:1.0 2:3.0",)], "value string"), 3, first=0, labelled=False)
    assert plain.first()["vector"] == [1.0, 0.0, 3.0]
    assert files.frame_times(0, 1, 0.5) == [0, 0.5, 1.0]


def test_memory_uris(spark):
    rows = spark.createDataFrame([("base64://YWI=",), ("data:text/plain;base64,YWI=",)], "uri string")
    assert {(bytes(r["content"]), r["content_type"]) for r in files.memory_elements(rows).collect()} == {(b"ab", None), (b"ab", "text/plain")}


def test_incremental_table(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "uid bigint, code bigint"
    table = incremental.VersionedTable(spark, str(tmp_path / "index"))
    for rows in ([(1, 1), (2, 2)], [(2, 5), (3, 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        incremental.maintain(stream, table, str(tmp_path / "check"), lambda b: b.withColumn("code", F.col("code") * 10)).awaitTermination()
    assert {r["uid"]: r["code"] for r in table.read().collect()} == {1: 10, 2: 50, 3: 30}
    table.merge(spark.createDataFrame([(2, 50), (3, 30)], schema), 1)
    assert table.read().count() == 3


def test_sessions(spark):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:30:00"), ("u", "2024-01-01 01:00:01")]
    events = spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r["n"] for r in incremental.sessions(events, "30 minutes").collect()) == [1, 2]
    hits = incremental.cache_hits(events.withColumnRenamed("user_id", "key"), 1800).orderBy("ts").collect()
    assert [r["hit"] for r in hits] == [False, False, False]
    hits = incremental.cache_hits(events.withColumnRenamed("user_id", "key"), 0).orderBy("ts").collect()
    assert [r["hit"] for r in hits] == [False, True, True]


def test_session_stream(spark, tmp_path):
    rows = [("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("v", "2024-01-02 00:00:00")]
    events = spark.createDataFrame(rows, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query, name = incremental.start_memory(incremental.sessions(stream, "30 minutes", watermark="1 minute"))
    assert [(r["user_id"], r["n"]) for r in spark.table(name).collect()] == [("u", 2)]
    assert incremental.progress(query)["rows"] >= 3


def test_centroids(spark):
    batch = spark.createDataFrame([(1, [0.0, 2.0]), (2, [10.0, 12.0])], "uid int, vector array<double>")
    new, n = incremental.step_centroids([[0.0, 0.0], [10.0, 10.0]], [1.0, 3.0], batch)
    assert new == [[0.0, 1.0], [10.0, 10.5]] and n == [2.0, 4.0]
