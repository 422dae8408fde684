"""Descriptor generators, fetched contents, key ranges, relational tables, factories and ball indexes."""

import hashlib
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.functions import numbers, text
from affinis.operators import balls, evaluate, ivf, knn, lsh
from affinis.plans import descriptors, indexes
from affinis.sources import jdbc, ranges, urls

KINDS = "uid string, content binary, content_type string"


def test_generators(spark):
    rows = spark.createDataFrame([("a", b"Abba b", "text/plain"), ("b", b"", "text/plain"), ("c", b"\x00\x10\xff\xf0", "image/png"), ("a", b"Abba b", "text/plain")], KINDS)
    got = descriptors.compute(rows, descriptors.Letters()).collect()
    assert len(got) == 1 and got[0]["vector"][:3] == pytest.approx([2 / 6, 3 / 6, 0])
    words = descriptors.compute(rows, descriptors.HashedWords(8)).first()["vector"]
    assert sum(words) == pytest.approx(1) and len(words) == 8
    halves = {r["uid"]: r["vector"] for r in descriptors.compute(rows, descriptors.ByteHistogram()).collect()}
    assert set(halves) == {"a", "c"} and halves["c"][0] == 0.25 and halves["c"][15] == 0.5
    with pytest.raises(Exception, match="content type"):
        descriptors.compute(rows, descriptors.Letters(), strict=True).collect()


def test_compute_skips_and_overwrites(spark):
    rows = spark.createDataFrame([("a", b"aa", "text/plain"), ("b", b"bb", "text/plain")], KINDS)
    done = spark.createDataFrame([("a", [9.0]), ("z", [8.0])], "uid string, vector array<double>")
    kept = {r["uid"]: r["vector"][0] for r in descriptors.compute(rows, descriptors.Letters(), done).collect()}
    assert kept == {"a": 9.0, "z": 8.0, "b": 0.0}
    new = {r["uid"]: r["vector"][0] for r in descriptors.compute(rows, descriptors.Letters(), done, overwrite=True).collect()}
    assert new == {"a": 1.0, "z": 8.0, "b": 0.0}
    both = descriptors.compute_transformed(rows, {"same": lambda c: c, "none": lambda c: F.lit("")}, descriptors.Letters()).collect()
    assert sorted((r["uid"], r["transform"]) for r in both) == [("a", "same"), ("b", "same")]


def test_fetch(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/x" else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(b"<p>x</p>")

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(f"{base}/x",), (f"{base}/gone",), ("no url",), (None,)], "url string")
    got = {r["url"]: r for r in urls.fetch(rows, timeout=5).collect()}
    few = urls.fetch(rows.limit(1), most_bytes=3).first()
    server.shutdown()
    assert bytes(got[f"{base}/x"]["content"]) == b"<p>x</p>" and got[f"{base}/x"]["content_type"] == "text/html"
    assert got[f"{base}/x"]["uid"] == hashlib.sha1(b"<p>x</p>").hexdigest() and got[f"{base}/x"]["error"] is None
    assert "404" in got[f"{base}/gone"]["error"] and got["no url"]["error"] and got[None]["error"] and "more than 3" in few["error"]


def test_key_ranges(spark, tmp_path):
    rows = spark.range(1000).withColumn("key", F.when(F.col("id") % 100 != 0, F.col("id") * 7 % 1000)).drop("id")
    cuts = ranges.key_ranges(rows, 5)
    assert len(cuts) == 5 and cuts[0][0] is None and cuts[-1][1] is None
    assert ranges.scan(spark, rows, cuts[:2], f"{tmp_path}/out") == 2
    assert ranges.scan(spark, rows, cuts, f"{tmp_path}/out", lambda r: r.withColumn("new", F.lit(1))) == 3
    back = ranges.read(spark, f"{tmp_path}/out")
    assert back.count() == 1000 and back.where("key is null").count() == 10
    assert sorted(r[0] or -1 for r in back.select("key").collect()) == sorted(r[0] or -1 for r in rows.collect())


def test_relational_tables(spark, tmp_path):
    """Through the driver of the database that comes with Spark."""
    table = jdbc.Table(f"jdbc:derby:{tmp_path}/db;create=true", "things", types="value VARCHAR(20), type_label VARCHAR(20)")
    first = spark.createDataFrame([(i, f"v{i}", "a" if i % 2 else "b") for i in range(20)], "key int, value string, type_label string")
    jdbc.write(first, table)
    assert jdbc.read(spark, table, ("key", 0, 20, 4)).count() == 20
    assert jdbc.of_type(spark, table, "a").count() == 10
    new = spark.createDataFrame([(3, "new", "a"), (99, "late", "a")], first.schema)
    jdbc.upsert(spark, table, new, "key")
    got = {r["key"]: r["value"] for r in jdbc.read(spark, table).collect()}
    assert len(got) == 21 and got[3] == "new" and got[99] == "late" and got[4] == "v4"
    with pytest.raises(Exception):  # noqa: B017
        jdbc.execute(spark, table, ["DELETE FROM things", "DELETE FROM nowhere"])
    assert jdbc.read(spark, table).count() == 21


def test_factory_names(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.random((300, 16)))], "uid bigint, vector array<double>")
    asked = rows.where("uid < 10").select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))
    exact = indexes.from_factory("IDMap,Flat").build(rows).search(asked, 5).cache()
    assert isinstance(indexes.from_factory("Flat"), indexes.Exact)
    for name, probes in (("IVF8,Flat", 8), ("PCAR16,IVF8,Flat", 8), ("IVF80,Flat", 80)):
        assert ivf.recall(indexes.from_factory(name, probes).build(rows).search(asked, 5), exact) == 1
    assert ivf.recall(indexes.from_factory("IVF80,Flat", 4).build(rows).search(asked, 5), exact) < 1
    assert exact.count() == 50 and indexes.from_factory("Flat").build(rows).search_page(asked, 5, 1, 3).count() == 20
    found, compared = indexes.from_factory("HNSW32", metric="euclidean").build(rows).searched(asked, 5)
    assert isinstance(indexes.from_factory("IDMap,HNSW16,Flat", metric="cosine"), indexes.Graph) and ivf.recall(found, exact) >= 0.9 and compared.count() == 10
    for bad in ("HNSW32,PQ4", "IVF8,PQ4", "OPQ4,Flat"):
        with pytest.raises(ValueError):
            indexes.from_factory(bad)
    make = indexes.INDEXES.factory({"type": "ivf", "ivf": {"cells": 3}})
    assert (make().cells, make(cells=5).cells) == (3, 5)


@pytest.mark.parametrize("bits", [8, 64, 256])
def test_codes_of_any_width(spark, bits):
    rng = np.random.default_rng(bits)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (200, 32)))], "uid bigint, vector array<double>")
    asked = rows.where("uid < 20").select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))
    index = indexes.Lsh(bits=bits, functor="random", n_codes=50).build(rows)
    got = index.search(asked, 3).where("rank = 1").collect()
    assert all(r["qid"] == r["uid"] and r["dist"] < 1e-6 for r in got) and len(got) == 20
    q = index.coded.where("uid < 20").select(F.col("uid").alias("qid"), F.col("code").alias("qcode"))
    whole = {(r["qid"], str(r["code"]), r["bits"]) for r in lsh.nearest_codes(index.coded, q, 7, bits).collect()}
    ball = {(r["qid"], str(r["code"]), r["bits"]) for r in balls.nearest_codes(*balls.build(index.coded, 12), q, 7, bits).collect()}
    assert whole == ball and len(whole) == 140


def test_many_queries(spark, monkeypatch):
    """Queries beyond what may be broadcast are joined in blocks; none is lost."""
    monkeypatch.setattr(knn, "MOST_QUERIES", 7)
    rows = spark.range(40).select(F.col("id").alias("uid"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    asked = rows.select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))
    got = knn.pairs(asked, rows)
    assert got.count() == 1600 and got.dropDuplicates(["qid", "uid"]).count() == 1600
    assert knn.nearest_batch(asked, rows, 1).where("qid = uid").count() == 40


def test_ranks_in_parts(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("aab"), rng.choice([0.5, rng.random()])) for i in range(400)]
    rows = spark.createDataFrame(data, "uid bigint, label string, score double")
    got = evaluate.ranked(rows, ["label"], [F.col("score"), F.col("uid")], F.floor(F.col("score") * 10)).collect()
    for label in "ab":
        want = sorted((s, i) for i, x, s in data if x == label)
        assert [(r["score"], r["uid"]) for r in sorted((r for r in got if r["label"] == label), key=lambda r: r["rank"])] == want
        assert {r["all"] for r in got if r["label"] == label} == {len(want)}
    steps = evaluate.cumulative(rows.withColumn("truth", (F.col("uid") % 2).cast("int"))).collect()
    for r in steps:
        assert r["tp"] == sum(i % 2 for i, _, s in data if s >= r["score"]) and r["fp"] == sum(1 - i % 2 for i, _, s in data if s >= r["score"])


def test_small_functions(spark):
    one = spark.createDataFrame([(1, '["a", "b"]'), (2, " [] "), (3, None)], "id int, j string")
    assert [r[0] for r in one.orderBy("id").select(text.json_list(F.col("j"))).collect()] == [["a", "b"], [], None]
    with pytest.raises(Exception, match="not a JSON list"):
        spark.createDataFrame([('{"a": 1}',)], "j string").select(text.json_list(F.col("j"))).collect()
    draw = lambda s: spark.range(3).select(text.random_characters(12, F.lit(s), F.col("id"))).collect()
    assert draw(1) == draw(1) != draw(2) and len({r[0] for r in draw(1)}) == 3 and all(len(r[0]) == 12 for r in draw(1))
    found = {r["id"]: r["f"] for r in spark.range(2, 3000).select("id", numbers.prime_factors(F.col("id")).alias("f")).collect()}
    for n, f in found.items():
        assert np.prod(f) == n and f == sorted(f) and all(p > 1 and all(p % d for d in range(2, int(p**0.5) + 1)) for p in f)
