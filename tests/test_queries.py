"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from affinis import queries as core

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = core.QUERIES[name](spark, DIR)
    cursor = duck.execute(core.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda rows: sorted(rows, key=repr)
    assert key(tuple(plain(r[c]) for c in columns) for r in got.collect()) == key(tuple(map(plain, r)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, DIR).count() > 0


def test_all_rows(spark):
    rows = core.vectors(spark, DIR)
    labels, n = {r["uid"]: r["label"] for r in rows.collect()}, rows.count()
    ids = lambda name, column: {r[0] for r in core.QUERIES[name](spark, DIR).select(column).collect()}
    for name in ("index_label_classifier", "neighbor_codes"):
        assert ids(name, "uid") == set(labels)
    cells = core.QUERIES["distance_kernel_symmetric"](spark, DIR)
    assert {labels[i] for i in ids("kernel_focus", "row_id")} == set(labels.values()) and ids("distance_kernel_symmetric", "row_id") == set(labels)
    assert cells.count() == sum(list(labels.values()).count(x) ** 2 for x in set(labels.values())) < n * n and cells.dropDuplicates(["row_id", "col_id"]).count() == cells.count()
    assert core.QUERIES["covariance"](spark, DIR).count() == 64 * 65 // 2
    larger = "/root/testdata/sf0.01"
    parts = spark.read.parquet(f"{larger}/part.parquet").count()
    for name, column in (("crop_tiles", "uid"), ("crop_centres", "uid"), ("crop_quadrants", "uid"), ("primes_and_factors", "n")):
        assert core.QUERIES[name](spark, larger).select(column).distinct().count() == parts > 300


def test_recall_of_registered_searches(spark):
    from affinis.operators import ivf, knn

    larger = "/root/testdata/sf0.1"
    rows = core.vectors(spark, larger)
    exact = {by: knn.nearest_batch(core.asked(rows), rows, 10, by).cache() for by in ("cosine", "euclidean")}
    searches = [("lsh_knn", "cosine"), ("lsh_wide_knn", "cosine"), ("itq_lsh_knn", "cosine"), ("ivf_knn", "euclidean"), ("mrpt_knn", "euclidean"), ("kdtree_knn", "euclidean"), ("graph_knn", "cosine")]
    found = {name: ivf.recall(core.QUERIES[name](spark, larger), exact[by]) for name, by in searches if name in core.QUERIES}
    short = core.short_vectors(spark, larger, core.TREE_DIMS)
    near = knn.nearest_batch(core.asked(short), short, 10).cache()
    for name in ("kmeans_tree_knn", "lsh_tables_knn"):
        found[name] = ivf.recall(core.QUERIES[name](spark, larger), near)
    print(found)
    assert min(found.values()) >= 0.9, found


def test_a_quarter_of_the_pool_is_enough(spark):
    """What the graph, the tree of k-means and the hash tables compare at sf0.1, at the registered settings."""
    from affinis.operators import tables, trees

    rows = core.vectors(spark, "/root/testdata/sf0.1")
    index = core.Graph().build(rows)
    _, compared = index.searched(core.asked(rows), 10)
    assert compared.agg(F.avg("compared")).first()[0] <= rows.count() / 4
    short = core.short_vectors(spark, "/root/testdata/sf0.1", core.TREE_DIMS)
    budget = short.count() // core.TREE_BUDGET
    built = trees.kmeans_build(short, 8, 32)
    _, compared = trees.kmeans_search(*built, core.asked(short), 10, budget)
    assert compared.agg(F.max("compared")).first()[0] <= budget + 32
    made = tables.Tables(core.TREE_DIMS, *core.PROBED_TABLES)
    hits = tables.candidates(made.index(short), core.asked(short), made, core.PROBES)
    assert hits.groupBy("qid").count().agg(F.avg("count")).first()[0] <= short.count() / 4


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
