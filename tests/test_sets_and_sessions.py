import pytest
from pyspark.sql import functions as F

from affinis.operators import sets
from affinis.operators.iqr import Controller, Session, train_from_state


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def log(spark, *steps):
    return table(spark, [("s", i, u, a) for i, step in enumerate(steps) for u, a in step], "sid string, batch int, uid string, action string")


def roles(spark, *steps):
    return {r["uid"]: r["role"] for r in sets.final_adjudication(log(spark, *steps)).collect()}


def test_adjudication_log(spark):
    assert roles(spark, [("a", "pos"), ("b", "neg")], [("a", "neg")]) == {"a": "neg", "b": "neg"}
    assert roles(spark, [("a", "pos"), ("a", "neg")]) == {}
    assert roles(spark, [("a", "pos")], [("a", "un_pos"), ("b", "un_neg")]) == {}
    assert roles(spark, [("a", "pos")], [("a", "un_neg")]) == {"a": "pos"}


def test_multi_get(spark):
    rows = table(spark, [(1, "a"), (2, "b")], "uid int, v string")
    wanted = table(spark, [(0, 2), (1, 1), (2, 2)], "pos int, uid int")
    assert [r["v"] for r in sets.ordered_get(rows, wanted).orderBy("pos").collect()] == ["b", "a", "b"]
    more = wanted.unionByName(table(spark, [(3, 9)], "pos int, uid int"))
    with pytest.raises(sets.MissingKeyError):
        sets.ordered_get(rows, more)
    assert sets.ordered_get(rows, more, strict=False).orderBy("pos").collect()[-1]["v"] is None


def test_key_values(spark):
    rows = table(spark, [("a", 1), ("b", 2)], "key string, value int")
    more = sets.upsert(rows, table(spark, [("b", 3), ("c", 4)], "key string, value int"))
    assert {r["key"]: r["value"] for r in more.collect()} == {"a": 1, "b": 3, "c": 4}
    with pytest.raises(KeyError):
        sets.remove(more, table(spark, [("a",), ("z",)], "key string"))
    assert sets.remove(more, table(spark, [("a",)], "key string")).count() == 2
    keys = table(spark, [("a",), ("z",)], "key string")
    assert {r["key"]: r["value"] for r in sets.get(more, keys, default=0).collect()} == {"a": 1, "z": 0}
    with pytest.raises(KeyError):
        sets.get(more, keys)


def test_disjoint_union(spark):
    a, b = table(spark, [(1,), (2,)], "id int"), table(spark, [(2,), (3,)], "id int")
    assert sorted(r[0] for r in sets.disjoint_union(a, b).collect()) == [1, 2, 4, 5]
    assert sorted(r[0] for r in sets.disjoint_union(a, b.where("id = 3")).collect()) == [1, 2, 3]
    assert sorted(r[0] for r in sets.symmetric_difference(a, b).collect()) == [1, 3]


@pytest.fixture()
def pool(spark):
    rows = [[float(i == j) for j in range(5)] for i in range(5)] + [[0.5, 0.0, 0.5, 0.0, 0.0], [0.2] * 5]
    return table(spark, list(enumerate(rows)), "uid int, vector array<double>").cache()


def test_session(spark, pool):
    session = Session(pool, neighbours=3, by="euclidean")
    with pytest.raises(ValueError):
        session.update_working_set()
    session.adjudicate(new_pos=[0], new_neg=[1])
    before = session.version
    session.adjudicate(new_pos=[0])
    assert session.version == before
    assert session.update_working_set().count() == 3
    results = session.refine(feedback=2)
    assert results.count() == 3 and session.feedback.count() == 2
    assert [r["uid"] for r in session.view("positive").collect()] == [0]
    assert 0 not in [r["uid"] for r in session.view("unadjudicated").collect()]
    other = Session(pool)
    other.restore(session.state())
    assert (other.positive, other.negative) == ({0}, {1})
    assert train_from_state(session.state()).labels == ["negative", "positive"]
    wrong = session.state().withColumn("vector", F.transform("vector", lambda x: x + 1))
    with pytest.raises(ValueError):
        other.restore(wrong)


def test_controller(pool):
    now = [0.0]
    controller = Controller(timeout=10, clock=lambda: now[0])
    sid = controller.add(Session(pool))
    now[0] = 10.0
    assert controller.get(sid).id == sid
    now[0] = 20.5
    gone = []
    assert controller.expire(gone.append) == [sid] and len(gone) == 1 and not controller.sessions
