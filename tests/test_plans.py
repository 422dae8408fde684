"""Table functions, estimators, the paged source, relevancy indexes, hash tables with probes and the autotuned index."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from affinis.operators import ivf, knn, tables
from affinis.plans import autotune, estimators, relevancy, udtf
from affinis.plans.indexes import INDEXES
from affinis.plans.registry import envelope
from affinis.sources import paged


def frame(spark, x, labels=None):
    rows = [(i, [float(c) for c in v], None if labels is None else f"c{labels[i]}") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "uid bigint, vector array<double>, label string")


def asked(rows, every):
    return rows.where(F.col("uid") % every == 0).select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))


def test_nearest_as_a_table_function(spark):
    rng = np.random.default_rng(0)
    rows = frame(spark, rng.random((90, 4)))
    udtf.register(spark)
    pairs = knn.pairs(asked(rows, 9), rows).createOrReplaceTempView("some_pairs")
    got = spark.sql("SELECT * FROM nearest(TABLE(some_pairs), 4)").collect()
    want = knn.nearest_batch(asked(rows, 9), rows, 4).collect()
    assert pairs is None and sorted(map(tuple, got)) == sorted((r["qid"], r["uid"], r["dist"], r["rank"]) for r in want)
    for bad in ("nearest(TABLE(some_pairs), 0)", "nearest(TABLE(SELECT 1 AS a), 2)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT * FROM {bad}").collect()
    spark.createDataFrame([(1, 5, 4), (2, 1, 9), (3, None, 2)], "uid int, width int, height int").createOrReplaceTempView("images")
    tiles = spark.sql("SELECT * FROM tiles(TABLE(images), 2, 2)").collect()
    assert sorted(map(tuple, tiles)) == [(1, 0, 0), (1, 0, 2), (1, 2, 0), (1, 2, 2)]


@pytest.mark.parametrize("functor", ["itq", "random"])
def test_code_estimator(spark, tmp_path, functor):
    rng = np.random.default_rng(1)
    rows = frame(spark, [*rng.random((80, 6))]).unionByName(spark.createDataFrame([(99, None, None)], "uid bigint, vector array<double>, label string"))
    model = Pipeline(stages=[estimators.Codes(bits=5, functor=functor)]).fit(rows)
    model.write().overwrite().save(str(tmp_path / "codes"))
    again = PipelineModel.load(str(tmp_path / "codes"))
    got, want = (sorted(map(tuple, m.transform(rows).select("uid", "code").collect()), key=repr) for m in (again, model))
    assert got == want and dict(got)[99] is None and len({c for _, c in got}) > 4
    with pytest.raises(ValueError):
        estimators.Codes().fit(rows.where("vector is null"))


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_label_estimator(spark, tmp_path, kind):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 120)
    rows = frame(spark, np.eye(3)[y] + rng.normal(0, 0.1, (120, 3)), y)
    model = estimators.LabelModel().train(rows, kind=kind)
    with pytest.raises(estimators.TrainedError):
        model.train(rows)
    model.save(str(tmp_path / "model"))
    again = estimators.LabelModel.load(str(tmp_path / "model"))
    assert again.labels == ["c0", "c1", "c2"]
    got = {r["uid"]: r["scores"] for r in again.transform(rows).collect()}
    assert sum(max(got[i], key=got[i].get) == f"c{y[i]}" for i in got) > 110
    with pytest.raises(estimators.TrainedError):
        again.train(rows)


@pytest.fixture
def listing():
    docs = [{"id": f"d{i:03d}", "n": i, "tags": ["a", i]} for i in range(57)]
    seen, failures = [], {"left": 3}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            seen.append(q)
            if failures["left"]:
                failures["left"] -= 1
                self.send_error(503)
                return
            found = [d for d in docs if d["n"] >= int(q.get("low", 0))]
            body = json.dumps({"response": {"numFound": len(found), "docs": found[int(q["start"]) : int(q["start"]) + int(q["rows"])]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args): ...

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?start={{start}}&rows={{rows}}&low={{low}}", docs, seen
    server.shutdown()


def test_paged_source(spark, listing, tmp_path):
    url, docs, seen = listing
    paged.register(spark)
    read = spark.read.format("paged").schema("id string, n int, tags string, gone double").option("url", url).option("rows", 5).option("pages", 3).option("filtered", "n")
    rows = read.load()
    got = rows.orderBy("id").collect()
    assert [(r["id"], r["n"], json.loads(r["tags"]), r["gone"]) for r in got] == [(d["id"], d["n"], d["tags"], None) for d in docs]
    assert rows.rdd.getNumPartitions() == 4
    seen.clear()
    assert rows.where("n >= 50").count() == 7 and {q["low"] for q in seen} == {"50"}

    def drain():
        stream = spark.readStream.format("paged").schema("id string, n int").option("url", url).option("rows", 5).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert drain() == 57
    docs += [{"id": f"e{i}", "n": 100 + i} for i in range(6)]
    seen.clear()
    assert drain() == 63 and {int(q["start"]) for q in seen if q["rows"] != "0"} == {57, 62}
    with pytest.raises(Exception, match="url is missing"):
        spark.read.format("paged").schema("id string").load().collect()


@pytest.mark.parametrize("name,config", [("intersection", {}), ("classifier", {}), ("classifier", {"kind": "rbf"})])
def test_relevancy_indexes(spark, name, config):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 60)
    rows = frame(spark, np.abs(np.eye(4)[y] + rng.normal(0, 0.05, (60, 4))), y)
    index = relevancy.RELEVANCY.make(envelope(name, relevancy.RELEVANCY.known[name], **config))
    own, other = rows.where("label = 'c0'").limit(8), rows.where("label = 'c1'").limit(8)
    with pytest.raises(relevancy.NotBuiltError):
        index.rank(own, other)
    with pytest.raises(ValueError):
        index.build(rows.limit(0))
    assert index.count() == 0 and index.build(rows.where("uid < 50")).update(rows.where("uid >= 40")).count() == 60
    score = {r["uid"]: r["score"] for r in index.rank(own, other).collect()}
    assert len(score) == 60 and min(score[i] for i in score if y[i] == 0) > max(score[i] for i in score if y[i] == 1)
    assert 0 <= min(score.values()) and max(score.values()) <= 1
    with pytest.raises(ValueError):
        index.rank(own, other.limit(0))


def test_tables_with_probes(spark):
    rng = np.random.default_rng(4)
    x = rng.random((30, 12))[rng.integers(0, 30, 1500)] + rng.normal(0, 0.08, (1500, 12))
    rows = frame(spark, x)
    queries = asked(rows, 75)
    made = tables.Tables(12, 6, 4, 0.7)
    indexed = made.index(rows)
    exact = knn.nearest_batch(queries, rows, 10)
    few, many = (tables.search(rows, indexed, queries, made, 10, probes=p) for p in (1, 16))
    looked = tables.candidates(indexed, queries, made, 16).groupBy("qid").count().agg(F.avg("count")).first()[0]
    assert indexed.count() == 6 * 1500 and made.probes(queries, 16).groupBy("qid", "table").count().where("count <> 16").count() == 0
    assert ivf.recall(few, exact) <= ivf.recall(many, exact) and ivf.recall(many, exact) >= 0.9 and looked <= 1500 / 4
    # A query's own cell is the first probe; the next lies across its nearest border.
    cell = np.floor(np.einsum("twd,d->tw", made.directions, x[0]) / 0.7 + made.shifts)
    place = np.einsum("twd,d->tw", made.directions, x[0]) / 0.7 + made.shifts
    keys = {(r["table"], r["key"]) for r in made.probes(queries.where("qid = 0"), 2).collect()}
    for t in range(6):
        gap = np.concatenate([place[t] - cell[t], cell[t] + 1 - place[t]])
        move = np.zeros(4, int)
        move[gap.argmin() % 4] = -1 if gap.argmin() < 4 else 1
        for c in (cell[t], cell[t] + move):
            key = spark.range(1).select(F.xxhash64(F.lit(t), F.array(*[F.lit(int(v)).cast("bigint") for v in c]))).first()[0]
            assert (t, key) in keys


def test_autotuned(spark):
    rng = np.random.default_rng(5)
    x = rng.random((25, 8))[rng.integers(0, 25, 1200)] + rng.normal(0, 0.05, (1200, 8))
    rows = frame(spark, x)
    index, found = autotune.autotuned(rows, 5, target=0.9, build_weight=0.0)
    assert {t.config["type"] for t in found} == {"exact", "ivf", "kmeans_tree", "graph"} and all(0 <= t.recall <= 1 for t in found)
    best = min((t for t in found if t.recall >= 0.9), key=lambda t: t.compared)
    assert INDEXES.known[best.config["type"]] is type(index) and best.compared < 600
    assert ivf.recall(index.search(asked(rows, 60), 5), knn.nearest_batch(asked(rows, 60), rows, 5)) >= 0.85
    # Where building counts for much and there are few searches, nothing is built.
    dear = min((t for t in found if t.recall >= 0.9), key=lambda t: t.cost(1.0, 0.0, 1.0))
    assert dear.config["type"] == "exact"
