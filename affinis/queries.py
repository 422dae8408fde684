"""Registered queries of the engine over the test tables, and the SQL that gives the same rows.

Vectors are ``embeddings`` (``vec_id``, ``embedding``, ``label``); histogram metrics use their absolute values over their sum.
Rankings break ties by id and distances are rounded to 6 digits, so that engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from affinis.functions import bits, geometry, numbers, text, vec
from affinis.operators import balls, codes, evaluate, hashing, iqr, knn, learn, lsh, mrpt, sets, svm, tables, trees
from affinis.plans import descriptors, sql, stored, udtf
from affinis.plans.indexes import Exact, Graph, Ivf, KdTree, KMeansTree, Lsh
from affinis.sources import files
from affinis.streaming import incremental

QUERIES: dict = {}
ORACLES: dict = {}
#: Queries against all rows: every id that this divides, and bits of the fixed projection.
EVERY, BITS = 50, 8
#: Codes that the hash index looks at, and trees and their depth: as many as find nine of ten neighbours.
N_CODES, TREES, DEPTH = 100, 12, 3


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), vec.doubles(F.col("embedding")).alias("vector"), "label")


def histograms(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("vector", vec.histogram(F.col("vector")))


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"))


def first_vector(rows: DataFrame, uid: int = 0) -> list[float]:
    return rows.where(F.col("uid") == uid).select("vector").first()[0]


V = "v AS (SELECT vec_id AS uid, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector, label FROM embeddings)"
H = f"{V}, h0 AS (SELECT uid, label, list_transform(vector, lambda x: abs(x)) AS a FROM v), h AS (SELECT uid, label, list_transform(a, lambda x: x / list_sum(a)) AS vector FROM h0)"
ZIP = "list_transform(range(1, len(a.vector) + 1), lambda i: {})"
L2 = "sqrt(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: (a.vector[i] - b.vector[i]) * (a.vector[i] - b.vector[i]))))"
COS = "list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: a.vector[i] * b.vector[i])) / (sqrt(list_sum(list_transform(a.vector, lambda x: x * x))) * sqrt(list_sum(list_transform(b.vector, lambda x: x * x))))"
ANGULAR = f"2 * acos(least(1.0, greatest(-1.0, {COS}))) / pi()"
HIK = "1 - list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: least(a.vector[i], b.vector[i])))"
MATRIX = [[float(x) for x in row] for row in hashing.sign_matrix(64, BITS)]
_COLUMNS = list(zip(*MATRIX, strict=True))
CODE = " + ".join(f"(CASE WHEN list_sum(list_transform(range(1, len(vector) + 1), lambda i: vector[i] * ({[int(x) for x in c]})[i])) >= 0 THEN {1 << (BITS - 1 - j)} ELSE 0 END)" for j, c in enumerate(_COLUMNS))
CODED = f"{V}, c AS (SELECT uid, label, vector, CAST({CODE} AS BIGINT) AS code FROM v)"


def projection() -> hashing.Projection:
    return hashing.Projection(MATRIX)


def coded(spark: SparkSession, d: str) -> DataFrame:
    return hashing.with_codes(vectors(spark, d), projection())


# Distances.


def _all_pairs(spark, d, rows, metric, digits=6):
    return knn.pairs(asked(rows(spark, d)), rows(spark, d), metric, digits)


def _pairs_sql(base: str, name: str, dist: str) -> str:
    return f"WITH {base} SELECT a.uid AS qid, b.uid AS uid, round({dist}, 6) AS dist FROM {name} a JOIN {name} b ON a.uid % {EVERY} = 0"


@query(_pairs_sql(V, "v", L2))
def dist_euclidean(spark, d):
    return _all_pairs(spark, d, vectors, "euclidean")


@query(_pairs_sql(V, "v", COS))
def dist_cosine_similarity(spark, d):
    return _all_pairs(spark, d, vectors, vec.cosine)


@query(_pairs_sql(V, "v", ANGULAR))
def dist_cosine_angular(spark, d):
    return _all_pairs(spark, d, vectors, "cosine")


@query(_pairs_sql(H, "h", HIK))
def dist_hik(spark, d):
    return _all_pairs(spark, d, histograms, "hik")


_CHI = f"list_sum({ZIP.format('CASE WHEN a.vector[i] + b.vector[i] > 0 THEN (a.vector[i] - b.vector[i]) * (a.vector[i] - b.vector[i]) / (a.vector[i] + b.vector[i]) ELSE 0.0 END')})"


@query(_pairs_sql(H, "h", _CHI))
def dist_chi_square(spark, d):
    return _all_pairs(spark, d, histograms, "chi_square")


@query(f"""WITH {H} SELECT a.uid AS qid, b.uid AS uid,
  round(list_sum({ZIP.format('abs(a.vector[i] - b.vector[i])')}), 6) AS l1,
  round(list_sum({ZIP.format('pow(abs(a.vector[i] - b.vector[i]), 3.0)')}), 6) AS minkowski3,
  round(list_max({ZIP.format('abs(a.vector[i] - b.vector[i])')}), 6) AS greatest,
  round(list_sum({ZIP.format('pow(sqrt(a.vector[i]) - sqrt(b.vector[i]), 2.0)')}), 6) AS hellinger,
  round(list_sum({ZIP.format('CASE WHEN a.vector[i] > 0 AND b.vector[i] > 0 THEN a.vector[i] * ln(a.vector[i] / b.vector[i]) ELSE 0.0 END')}), 6) AS kl
FROM h a JOIN h b ON a.uid % {EVERY} = 0""")
def dist_family(spark, d):
    rows = histograms(spark, d)
    a, b = F.col("qvector"), F.col("vector")
    plain = {"l1": vec.manhattan(a, b), "minkowski3": vec.minkowski(a, b, 3), "greatest": vec.chebyshev(a, b), "hellinger": vec.hellinger(a, b), "kl": vec.kullback_leibler(a, b)}
    return knn.measured(asked(rows), rows, {"l1": "manhattan", "minkowski3": "minkowski3", "greatest": "chebyshev", "hellinger": "hellinger", "kl": "divergence"}, 6, plain)


@query(f"WITH {CODED} SELECT a.uid AS qid, b.uid AS uid, CAST(bit_count(xor(a.code, b.code)) AS INT) AS bits FROM c a JOIN c b ON a.uid % {EVERY} = 0")
def dist_hamming(spark, d):
    rows = coded(spark, d).select("uid", "code")
    q = rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("code").alias("qcode"))
    return knn.crossed(rows, q, "qid").select("qid", "uid", bits.hamming(F.col("code"), F.col("qcode")).alias("bits"))


@query(f"""WITH {V} SELECT uid, list_transform(vector, lambda x: round(x / sqrt(list_sum(list_transform(vector, lambda y: y * y))), 6) + 0.0) AS l2,
  round(list_sum(list_transform(vector, lambda x: abs(x))), 6) AS norm1, round(list_max(list_transform(vector, lambda x: abs(x))), 6) AS norm_inf FROM v""")
def vec_norm(spark, d):
    x = F.col("vector")
    return vectors(spark, d).select("uid", F.transform(vec.normalized(x, 2), lambda v: F.round(v, 6) + 0.0).alias("l2"), F.round(vec.norm(x, 1), 6).alias("norm1"), F.round(vec.norm(x, "inf"), 6).alias("norm_inf"))


@query(f"""WITH {H}, m AS (SELECT uid, list_transform(range(1, 65), lambda i: vector[i] * exp(((i - 1) % 3) * 1.0 - 2.0)) AS w FROM h)
SELECT uid, list_transform(w, lambda x: round(x / list_sum(w), 6)) AS p FROM m""")
def proba_adjust(spark, d):
    adjustment = knn.literal([float(i % 3) for i in range(64)])
    return histograms(spark, d).select("uid", F.transform(vec.checked_adjustment(F.col("vector"), adjustment), lambda x: F.round(x, 6)).alias("p"))


# Nearest neighbours.


def _ranked(base: str, name: str, dist: str, n: int, where: str = "true", order: str = "dist, uid") -> str:
    return f"""WITH {base}, p AS (SELECT a.uid AS qid, b.uid AS uid, round({dist}, 6) AS dist FROM {name} a JOIN {name} b ON a.uid % {EVERY} = 0 AND {where})
SELECT qid, uid, dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM p) WHERE rank <= {n}"""


@query(f"WITH {V} SELECT b.uid, round({L2}, 6) AS dist FROM v a JOIN v b ON a.uid = 0 ORDER BY dist, b.uid LIMIT 10")
def knn_single(spark, d):
    rows = vectors(spark, d)
    knn.check_searchable(rows, q := first_vector(rows))
    return knn.nearest(rows, q, 10, digits=6)


@query(_ranked(V, "v", ANGULAR, 10))
def knn_batch_topk(spark, d):
    rows = vectors(spark, d)
    return knn.nearest_batch(asked(rows), rows, 10, "cosine", 6)


@query(_ranked(V, "v", L2, 10, "a.uid <> b.uid"))
def knn_self_excluded(spark, d):
    rows = vectors(spark, d)
    return knn.nearest_batch(asked(rows), rows, 10, "euclidean", 6, skip_self=True)


@query(_ranked(H, "h", HIK, 10))
def knn_hik(spark, d):
    rows = histograms(spark, d)
    return knn.nearest_batch(asked(rows), rows, 10, "hik", 6)


def _kernels(spark, d) -> DataFrame:
    """One kernel for each label."""
    return knn.kernel(histograms(spark, d), "hik", 6, within="label", keep=False)


def _focused(spark, d) -> DataFrame:
    rows = histograms(spark, d)
    return knn.focused(rows, rows.where("uid % 3 = 0").select("uid"), rows.where("uid % 2 = 0").select("uid"), "hik", 6, within="label")


@query(f"WITH {H} SELECT a.uid AS row_id, b.uid AS col_id, round({HIK}, 6) AS dist FROM h a JOIN h b ON a.label = b.label")
def distance_kernel_symmetric(spark, d):
    return _kernels(spark, d)


@query(f"""WITH {H}, f AS (SELECT uid, min(bg) AS bg FROM (SELECT uid, uid % 3 <> 0 AS bg FROM h WHERE uid % 3 = 0 OR uid % 2 = 0) GROUP BY uid)
SELECT a.uid AS row_id, b.uid AS col_id, round({HIK}, 6) AS dist, fa.bg AS row_background, fb.bg AS col_background FROM h a JOIN f fa ON a.uid = fa.uid JOIN h b ON a.label = b.label JOIN f fb ON b.uid = fb.uid""")
def kernel_focus(spark, d):
    return _focused(spark, d)


@query(f"WITH {H} SELECT a.uid AS row_id, b.uid AS col_id, round({HIK}, 6) AS dist FROM h a JOIN h b ON a.label = b.label")
def kernel_update(spark, d):
    """The kernels of all labels, from those without a third of the rows, to which these are added."""
    rows = histograms(spark, d)
    old, new = rows.where("uid % 3 <> 1"), rows.where("uid % 3 = 1")
    start = knn.kernel_without(knn.kernel(rows.where("uid % 3 <> 2 or uid % 2 = 0"), "hik", 6, within="label"), new.select("uid"))
    late = old.where("uid % 3 = 2 and uid % 2 <> 0")
    first = knn.kernel_with(start, old.where("uid % 3 <> 2 or uid % 2 = 0"), late, "hik", 6, within="label")
    return knn.kernel_with(first, old, new, "hik", 6, within="label")


@query(f"WITH {H} SELECT a.uid AS row_id, b.uid AS col_id, round({L2}, 6) AS dist FROM h a JOIN h b ON a.label + 1 = b.label")
def distance_matrix(spark, d):
    """All rows of each label with all rows of the next."""
    rows = histograms(spark, d)
    return knn.matrix(rows.withColumn("label", F.col("label") + 1), rows, "euclidean", 6, on="label", keep=False)


@query(f"WITH {V}, p AS (SELECT b.uid, round({L2}, 6) AS dist FROM v a JOIN v b ON a.uid = 0) SELECT uid, dist FROM p ORDER BY dist, uid LIMIT 20 OFFSET 10")
def result_page(spark, d):
    rows = vectors(spark, d)
    ranked = rows.select("uid", F.round(vec.euclidean(F.col("vector"), knn.literal(first_vector(rows))), 6).alias("dist"))
    return knn.page(ranked, 10, 30, [F.col("dist"), F.col("uid")])


@query("SELECT uid, ord FROM (SELECT vec_id AS uid, md5('7:' || vec_id) AS ord FROM embeddings) ORDER BY ord, uid LIMIT 25")
def random_uids(spark, d):
    return knn.shuffled(vectors(spark, d), 7, 0, 25)


# Keyed collections.


@query("SELECT CAST(p.page_id AS BIGINT) AS pos, e.vec_id AS uid, e.label FROM pages p JOIN embeddings e ON e.vec_id = (p.page_id * 37) % (SELECT count(*) FROM embeddings)")
def multi_get_ordered(spark, d):
    """A vector's label for every page, by a number of the page; many ask for the same."""
    rows = vectors(spark, d).select("uid", "label")
    wanted = table(spark, d, "pages").select(F.col("page_id").cast("bigint").alias("pos"), (F.col("page_id") * 37 % rows.count()).alias("uid"))
    return sets.ordered_get(rows, wanted).select("pos", "uid", "label")


@query("SELECT vec_id AS uid, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def anti_uncomputed(spark, d):
    return sets.not_computed(vectors(spark, d).select("uid", "label"), table(spark, d, "labels").select(F.col("doc_id").alias("uid")))


@query("SELECT doc_id AS key, 'q' || quality AS value FROM labels UNION ALL SELECT vec_id, 'e' || label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def kv_upsert(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("e"), F.col("label").cast("string")).alias("value"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("key"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    return sets.upsert(old, new)


@query("SELECT vec_id AS key, label AS value FROM embeddings WHERE vec_id % 3 <> 0")
def kv_remove_many(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("value"))
    return sets.remove(rows, rows.where("key % 3 = 0").select("key"))


@query("SELECT o.doc_id AS key, coalesce(e.label, -1) AS value FROM documents o LEFT JOIN embeddings e ON e.vec_id = o.doc_id")
def kv_get_default(spark, d):
    """The label of the vector of every document's id, -1 for those without."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("value"))
    return sets.get(rows, table(spark, d, "documents").select(F.col("doc_id").alias("key")), default=-1)


_LOG = "SELECT user_id AS sid, event_id % 97 AS uid, CAST(floor(event_id / 50) AS BIGINT) AS batch, CASE WHEN event_id % 7 < 3 THEN 'pos' WHEN event_id % 7 < 5 THEN 'neg' WHEN event_id % 7 = 5 THEN 'un_pos' ELSE 'un_neg' END AS action FROM events"


@query(f"""WITH RECURSIVE log AS ({_LOG}),
b AS (SELECT sid, uid, batch, max(action = 'pos') AS p, max(action = 'neg') AS n, max(action = 'un_pos') AS up, max(action = 'un_neg') AS un FROM log GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY sid, uid ORDER BY batch) AS k FROM b),
r AS (SELECT sid, uid, k, p AND NOT up AND NOT n AS sp, n AND NOT un AND NOT p AS sn FROM o WHERE k = 1
  UNION ALL SELECT o.sid, o.uid, o.k, (r.sp OR o.p) AND NOT o.up AND NOT o.n, (r.sn OR o.n) AND NOT o.un AND NOT o.p FROM r JOIN o ON o.sid = r.sid AND o.uid = r.uid AND o.k = r.k + 1)
SELECT sid, uid, CASE WHEN sp THEN 'pos' ELSE 'neg' END AS role FROM r WHERE (sp OR sn) AND k = (SELECT max(k) FROM o WHERE o.sid = r.sid AND o.uid = r.uid)""")
def adjudicate_final_state(spark, d):
    e = F.col("event_id") % 7
    action = F.when(e < 3, "pos").when(e < 5, "neg").when(e == 5, "un_pos").otherwise("un_neg")
    log = table(spark, d, "events").select(F.col("user_id").alias("sid"), (F.col("event_id") % 97).alias("uid"), F.floor(F.col("event_id") / 50).alias("batch"), action.alias("action"))
    return sets.final_adjudication(log)


@query("(SELECT vec_id AS id FROM embeddings EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings)")
def symmetric_difference(spark, d):
    return sets.symmetric_difference(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT vec_id AS id, 'e' AS side FROM embeddings UNION ALL SELECT page_id + (SELECT max(vec_id) FROM embeddings), 'p' FROM pages")
def disjoint_union(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("e").alias("side"))
    return sets.disjoint_union(a, table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("p").alias("side")))


# Hash codes and indexes.


@query(f"WITH {CODED} SELECT uid, code FROM c")
def rp_hash_codes(spark, d):
    return coded(spark, d).select("uid", "code")


@query(f"WITH {CODED} SELECT code, list_sort(list(DISTINCT uid)) AS uids FROM c GROUP BY code")
def hash_buckets(spark, d):
    return lsh.buckets(coded(spark, d))


@query("SELECT count(*) AS n FROM embeddings")
def index_count(spark, d):
    return lsh.count(coded(spark, d))


@query(f"WITH {CODED} SELECT uid, code FROM c WHERE uid % 4 = 0")
def unhashed_uids(spark, d):
    rows = coded(spark, d).select("uid", "code")
    return sets.unhashed(rows, lsh.buckets(rows.where("uid % 4 <> 0")))


_NEAR = f"""{CODED}, k AS (SELECT DISTINCT code FROM c), n AS (
  SELECT q.uid AS qid, k.code, CAST(bit_count(xor(k.code, q.code)) AS INT) AS bits FROM c q CROSS JOIN k WHERE q.uid % {EVERY} = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bits, code) AS r FROM n)"""


@query(f"WITH {_NEAR} SELECT qid, code, bits, bits / 8.0::DOUBLE AS distance FROM t WHERE r <= 5")
def hamming_topn_codes(spark, d):
    rows = coded(spark, d)
    q = rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("code").alias("qcode"))
    return lsh.nearest_codes(rows, q, 5, BITS)


@query(f"""WITH {_NEAR}, p AS (SELECT t.qid, b.uid, round({ANGULAR}, 6) AS dist FROM t JOIN c b ON b.code = t.code JOIN c a ON a.uid = t.qid WHERE r <= {N_CODES})
SELECT qid, uid, dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, uid) AS rank FROM p) WHERE rank <= 10""")
def lsh_knn(spark, d):
    rows = coded(spark, d)
    q = rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"), F.col("code").alias("qcode"))
    return lsh.search(rows, q, 10, BITS, "cosine", n_codes=N_CODES, digits=6)


WIDE, WIDE_CODES = 80, 1000
_WIDE_BITS = "list_transform([" + ", ".join(f"list_sum(list_transform(range(1, len(vector) + 1), lambda i: vector[i] * ({[int(row[j]) for row in hashing.sign_matrix(64, WIDE)]})[i]))" for j in range(WIDE)) + "], lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END)"
_WIDE_DIFFER = f"list_sum(list_transform(range(1, {WIDE + 1}), lambda i: abs(q.bits[i] - k.bits[i])))"


@query(f"""WITH {V}, c AS (SELECT uid, vector, {_WIDE_BITS} AS bits FROM v), k AS (SELECT DISTINCT bits FROM c), n AS (SELECT q.uid AS qid, k.bits, {_WIDE_DIFFER} AS differ FROM c q CROSS JOIN k WHERE q.uid % {EVERY} = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY differ, bits) AS r FROM n), p AS (SELECT t.qid, b.uid, round({ANGULAR}, 6) AS dist FROM t JOIN c b ON b.bits = t.bits JOIN c a ON a.uid = t.qid WHERE r <= {WIDE_CODES})
SELECT qid, uid, dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, uid) AS rank FROM p) WHERE rank <= 10""")
def lsh_wide_knn(spark, d):
    rows = hashing.with_codes(vectors(spark, d), hashing.Projection([[float(x) for x in row] for row in hashing.sign_matrix(64, WIDE)]))
    q = rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("vector").alias("qvector"), F.col("code").alias("qcode"))
    return lsh.search(rows, q, 10, WIDE, "cosine", n_codes=WIDE_CODES, digits=6)


@query(f"WITH {CODED}, m AS (SELECT range AS mask FROM range(0, 256) WHERE bit_count(range) = 2) SELECT uid, xor(code, mask) AS near FROM c CROSS JOIN m")
def neighbor_codes(spark, d):
    return coded(spark, d).select("uid", F.explode(bits.neighbours(F.col("code"), BITS, 2)).alias("near"))


@query(f"WITH {CODED} SELECT uid, CAST(bit_count(code) AS INT) AS ones, list_transform(range(0, 8), lambda i: CAST((code >> (7 - i)) & 1 AS INT)) AS bits, code AS again FROM c")
def code_bits(spark, d):
    b = bits.from_int(F.col("code"), BITS)
    return coded(spark, d).select("uid", bits.popcount(F.col("code")).alias("ones"), b.alias("bits"), bits.to_int(b).alias("again"))


_RANDOM = hashing.random_projection(64, BITS, seed=3).matrix
_RANDOM_CODE = " + ".join(f"(CASE WHEN list_sum(list_transform(range(1, 65), lambda i: vector[i] * ({[row[j] for row in _RANDOM]}::DOUBLE[])[i])) >= 0 THEN {1 << (BITS - 1 - j)} ELSE 0 END)" for j in range(BITS))


@query(f"WITH {V} SELECT uid, CAST({_RANDOM_CODE} AS BIGINT) AS code FROM v")
def random_projection_codes(spark, d):
    return hashing.with_codes(vectors(spark, d), hashing.random_projection(64, BITS, seed=3)).select("uid", "code")


@query(f"WITH {_NEAR} SELECT qid, code, bits, bits / 8.0::DOUBLE AS distance FROM t WHERE r <= 5")
def ball_codes(spark, d):
    rows = coded(spark, d)
    members, shapes = balls.build(rows, 16)
    q = rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("code").alias("qcode"))
    return balls.nearest_codes(members, shapes, q, 5, BITS)


@query()
def itq_hash(spark, d):
    rows = vectors(spark, d)
    return hashing.with_codes(rows, hashing.fit_itq(rows, BITS)).select("uid", "code")


@query()
def itq_lsh_knn(spark, d):
    rows = vectors(spark, d)
    return Lsh(bits=BITS, n_codes=200).build(rows).search(asked(rows), 10)


@query()
def ivf_knn(spark, d):
    rows = vectors(spark, d)
    return Ivf(cells=16, probes=11).build(rows).search(asked(rows), 10)


_DIRECTIONS = [[[float(row[t * DEPTH + level]) for row in hashing.sign_matrix(64, TREES * DEPTH)] for level in range(DEPTH)] for t in range(TREES)]


def _mrpt_sql() -> str:
    parts = [V]
    for t, tree in enumerate(_DIRECTIONS):
        parts.append(f"t{t}_0 AS (SELECT uid, vector, CAST(1 AS BIGINT) AS node FROM v), q{t}_0 AS (SELECT uid AS qid, vector AS qvector, CAST(1 AS BIGINT) AS node FROM v WHERE uid % {EVERY} = 0)")
        for level, direction in enumerate(tree):
            p = lambda x, direction=direction: f"list_sum(list_transform(range(1, len({x}) + 1), lambda i: {x}[i] * ({[int(y) for y in direction]})[i]))"
            parts.append(f"p{t}_{level} AS (SELECT *, {p('vector')} AS p FROM t{t}_{level}), s{t}_{level} AS (SELECT node, quantile_disc(p, 0.5) AS m FROM p{t}_{level} GROUP BY node)")
            parts.append(f"t{t}_{level + 1} AS (SELECT uid, vector, x.node * 2 + CASE WHEN p < s.m THEN 0 ELSE 1 END AS node FROM p{t}_{level} x JOIN s{t}_{level} s ON x.node = s.node)")
            parts.append(f"q{t}_{level + 1} AS (SELECT qid, qvector, q.node * 2 + CASE WHEN {p('qvector')} < s.m THEN 0 ELSE 1 END AS node FROM q{t}_{level} q JOIN s{t}_{level} s ON q.node = s.node)")
    hits = " UNION ".join(f"SELECT q.qid, x.uid FROM q{t}_{DEPTH} q JOIN t{t}_{DEPTH} x ON q.node = x.node" for t in range(TREES))
    return f"""WITH {', '.join(parts)}, hits AS ({hits}),
d AS (SELECT h.qid, h.uid, round(list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: (a.vector[i] - b.vector[i]) * (a.vector[i] - b.vector[i]))), 6) AS dist FROM hits h JOIN v a ON a.uid = h.qid JOIN v b ON b.uid = h.uid)
SELECT qid, uid, dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, uid) AS rank FROM d) WHERE rank <= 10"""


@query(_mrpt_sql())
def mrpt_knn(spark, d):
    rows = vectors(spark, d)
    built, splits = mrpt.build(rows, _DIRECTIONS)
    return mrpt.search(rows, built, asked(rows), _DIRECTIONS, splits, 10, digits=6)


@query()
def kdtree_knn(spark, d):
    rows = vectors(spark, d)
    return KdTree(trees=20, depth=3).build(rows).search(asked(rows), 10)


@query()
def graph_knn(spark, d):
    rows = vectors(spark, d)
    return Graph().build(rows).search(asked(rows), 10)


#: Leading dimensions of the vectors that the kd-tree and the tree of k-means index.
KD_DIMS, TREE_DIMS, TREE_BUDGET = 3, 6, 4
_SHORT = f"{V}, k AS (SELECT uid, vector[1 : {KD_DIMS}] AS vector FROM v)"


def short_vectors(spark, d, width: int) -> DataFrame:
    return vectors(spark, d).withColumn("vector", F.slice("vector", 1, width))


@query(_ranked(_SHORT, "k", L2, 10))
def kd_exact_knn(spark, d):
    """Exact neighbours in the first dimensions, by branch and bound."""
    rows = short_vectors(spark, d, KD_DIMS)
    return trees.kd_search(*trees.kd_build(rows, 32), asked(rows), 10, digits=6)[0]


@query()
def kmeans_tree_knn(spark, d):
    """Neighbours in the first dimensions, among a quarter of the pool."""
    rows = short_vectors(spark, d, TREE_DIMS)
    return KMeansTree(8, 32, budget=rows.count() // TREE_BUDGET).build(rows).search(asked(rows), 10)


#: Tables, projections of each, width of cells in units of the vectors, and probes of a table.
PROBED_TABLES, PROBES = (5, 4, 0.25), 8


@query()
def lsh_tables_knn(spark, d):
    """Neighbours in the first dimensions, from the cells that queries probe in a few hash tables."""
    rows = short_vectors(spark, d, TREE_DIMS)
    made = tables.Tables(TREE_DIMS, *PROBED_TABLES)
    return tables.search(rows, made.index(rows), asked(rows), made, 10, PROBES)


@query(_ranked(V, "v", L2, 10))
def udtf_nearest(spark, d):
    """Exact neighbours in SQL, ranked by a table function."""
    udtf.register(spark)
    rows = vectors(spark, d)
    # The nearest rows of each task hold the nearest of all.
    pairs = knn.nearest_pairs(asked(rows), rows, 10, "euclidean", 6)
    return spark.sql("SELECT * FROM nearest(TABLE(SELECT * FROM {pairs}), 10)", pairs=pairs)


@query(_ranked(H, "h", _CHI, 10))
def knn_chi_square(spark, d):
    rows = histograms(spark, d)
    return Exact("chi_square", digits=6).build(rows).search(asked(rows), 10)


#: Bits of the codes that are searched by pieces and by a tree of balls.
PIECED = 32
_PIECED_CODE = " + ".join(f"(CASE WHEN list_sum(list_transform(range(1, 65), lambda i: vector[i] * ({[int(row[j]) for row in hashing.sign_matrix(64, PIECED)]})[i])) >= 0 THEN {1 << (PIECED - 1 - j)}::BIGINT ELSE 0 END)" for j in range(PIECED))
_PIECED = f"""WITH {V}, c AS (SELECT uid, CAST({_PIECED_CODE} AS BIGINT) AS code FROM v), k AS (SELECT DISTINCT code FROM c),
t AS (SELECT q.uid AS qid, k.code, CAST(bit_count(xor(q.code, k.code)) AS INT) AS bits FROM c q CROSS JOIN k WHERE q.uid % {EVERY} = 0)
SELECT qid, code, bits, bits / {PIECED}.0::DOUBLE AS distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bits, code) AS r FROM t) WHERE r <= 5"""


def pieced(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = hashing.with_codes(vectors(spark, d), hashing.Projection([[float(x) for x in row] for row in hashing.sign_matrix(64, PIECED)])).select("uid", "code")
    return rows, rows.where(F.col("uid") % EVERY == 0).select(F.col("uid").alias("qid"), F.col("code").alias("qcode"))


@query(_PIECED)
def piece_codes(spark, d):
    """Nearest codes, exactly, by tables of their pieces."""
    return codes.nearest_codes(*pieced(spark, d), 5, PIECED)[0]


@query(_PIECED)
def ball_tree_codes(spark, d):
    """Nearest codes, exactly, by a tree of balls."""
    rows, q = pieced(spark, d)
    return balls.nearest_in_tree(rows, *balls.tree(rows), q, 5, PIECED)


@query(ORACLES["lsh_knn"])
def stored_lsh_knn(spark, d):
    """As ``lsh_knn``, from an index written to a folder and loaded again."""
    rows = vectors(spark, d)
    index = Lsh(bits=BITS, n_codes=N_CODES, functor="random")
    index.projection = projection()
    index = stored.save(index.build(rows), stored.new_folder(spark))
    return stored.load(spark, index.path).search(asked(rows), 10, digits=6)


# Labels, scores and folds. A vector's score for a label is its share in ten bins of its histogram.

_SCORES = f"{H}, s AS (SELECT uid, label, list_transform(range(0, 10), lambda b: list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i % 10 = b THEN vector[i] ELSE 0.0 END))) AS s FROM h)"
_BEST = f"{_SCORES}, m AS (SELECT uid, label, unnest(range(0, 10)) AS l, unnest(s) AS score FROM s), best AS (SELECT uid, label AS truth, CAST(l AS VARCHAR) AS predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, CAST(l AS VARCHAR)) AS r FROM m) WHERE r = 1)"


def scored(spark, d) -> DataFrame:
    """``(uid, truth, scores)``."""
    bins = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: vec.total(F.transform("vector", lambda x, i: F.when((i + 1) % 10 == b, x).otherwise(0.0))))
    keys = F.array(*[F.lit(str(i)) for i in range(10)])
    return histograms(spark, d).select("uid", F.col("label").cast("string").alias("truth"), F.map_from_arrays(keys, bins).alias("scores"))


def predicted(spark, d) -> DataFrame:
    rows = scored(spark, d)
    return rows.select("uid", "truth").join(evaluate.argmax_label(rows).withColumnRenamed("label", "predicted"), "uid")


@query(f"WITH {_BEST} SELECT uid, predicted AS label, round(score, 6) AS score FROM best")
def argmax_label(spark, d):
    return evaluate.argmax_label(scored(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {_BEST} SELECT uid, predicted AS label FROM best WHERE predicted = '3'")
def label_filter(spark, d):
    return learn.with_label(scored(spark, d), "3").select("uid", "label")


_CELLS = f"{_BEST}, l AS (SELECT CAST(truth AS VARCHAR) AS x FROM best UNION SELECT predicted FROM best), cells AS (SELECT a.x AS truth, b.x AS predicted, (SELECT count(*) FROM best WHERE CAST(truth AS VARCHAR) = a.x AND predicted = b.x) AS n FROM l a CROSS JOIN l b)"


@query(f"WITH {_CELLS} SELECT truth, predicted, n FROM cells")
def confusion_matrix(spark, d):
    return evaluate.confusion(predicted(spark, d))


@query(f"WITH {_CELLS} SELECT truth, predicted, round(CASE WHEN sum(n) OVER (PARTITION BY truth) > 0 THEN n / sum(n) OVER (PARTITION BY truth) ELSE 0.0 END, 6) AS share FROM cells")
def confusion_normalized(spark, d):
    return evaluate.normalized(evaluate.confusion(predicted(spark, d)))


@query(f"WITH {_BEST} SELECT CAST(truth AS VARCHAR) AS truth, predicted, list_sort(list(uid)) AS uids FROM best GROUP BY ALL")
def confusion_uids(spark, d):
    return evaluate.confusion_uids(predicted(spark, d))


@query(f"WITH {V}, u AS (SELECT unnest(range(0, 64)) AS pos, unnest(vector) AS x FROM v) SELECT CAST(pos AS INT) AS pos, round(avg(x), 6) + 0.0 AS mean FROM u GROUP BY pos")
def mean_vector(spark, d):
    return hashing.mean_vector(vectors(spark, d)).select("pos", (F.round("mean", 6) + 0.0).alias("mean"))


@query(f"WITH {V}, g AS (SELECT unnest(range(0, 64)) AS i), c AS (SELECT a.i, b.i AS j, vector[a.i + 1] AS x, vector[b.i + 1] AS y FROM v CROSS JOIN g a JOIN g b ON a.i <= b.i) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(covar_samp(x, y), 6) + 0.0 AS cov FROM c GROUP BY i, j")
def covariance(spark, d):
    return hashing.covariance(vectors(spark, d)).select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


_MEMBERS = "SELECT l_orderkey % 40 AS grp, l_orderkey AS item, (l_quantity - 1) / 49.0 AS score FROM lineitem"


@query(f"WITH m AS ({_MEMBERS}), i AS (SELECT grp, item, max(score) AS hi, avg(score) AS mean FROM m GROUP BY ALL), a AS (SELECT grp, round(max(hi), 6) AS max_score, round(avg(mean), 6) AS avg_score FROM i GROUP BY grp) SELECT g AS grp, coalesce(max_score, 0.5) AS max_score, coalesce(avg_score, 0.5) AS avg_score FROM range(0, 50) t(g) LEFT JOIN a ON a.grp = g")
def score_pooling_max_avg(spark, d):
    members = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("grp"), F.col("l_orderkey").alias("item"), ((F.col("l_quantity") - 1) / 49.0).alias("score"))
    out = evaluate.pooled(members, "item", "grp", default=0.5, parents=spark.range(50).withColumnRenamed("id", "grp"))
    return out.withColumn("max_score", F.round("max_score", 6))


@query("SELECT turn % 5 AS parent, max(length(text)) AS max_score FROM conversations WHERE conv_id IN (SELECT vec_id FROM embeddings WHERE label < 5) GROUP BY ALL")
def pooling_available_max(spark, d):
    members = table(spark, d, "conversations").select((F.col("turn") % 5).alias("parent"), F.col("conv_id").alias("uid"), F.char_length("text").cast("bigint").alias("score"))
    return evaluate.pooled_available(members, vectors(spark, d).where("label < 5"), "parent")


@query("WITH m AS (SELECT CAST(l_orderkey % 10 AS BIGINT) AS grp, least(floor((l_quantity - 1) / 49.0 * 20), 19) AS b FROM lineitem), g AS (SELECT DISTINCT grp FROM m) SELECT g.grp, CAST(x AS INT) AS bin, round((SELECT count(*) FROM m WHERE m.grp = g.grp AND b = x) / (SELECT count(*) FROM m WHERE m.grp = g.grp), 6) AS share FROM g CROSS JOIN range(0, 20) t(x)")
def score_histogram(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 10).alias("grp"), ((F.col("l_quantity") - 1) / 49.0).alias("score"))
    return evaluate.score_histogram(rows, "grp")


@query("WITH c AS (SELECT source, count(*) AS trials, count(*) FILTER (WHERE lang = 'en') AS successes FROM documents GROUP BY source), p AS (SELECT *, successes / trials AS p, 1.959963984540054 AS z FROM c) SELECT source, trials, successes, round((p + z * z / (2 * trials)) / (1 + z * z / trials) - z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / (1 + z * z / trials), 6) AS low, round((p + z * z / (2 * trials)) / (1 + z * z / trials) + z * sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / (1 + z * z / trials), 6) AS high FROM p")
def wilson_ci(spark, d):
    counts = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("trials"), F.sum((F.col("lang") == "en").cast("bigint")).alias("successes"))
    return evaluate.wilson(counts)


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(exp((SELECT avg(ln(n)) FROM c)) / n, 6) AS weight FROM c")
def class_weights(spark, d):
    return evaluate.class_weights(vectors(spark, d))


@query("SELECT round(greatest(1.0, sum(1 - toxic) / sum(toxic)), 6) AS weight FROM labels")
def positive_weight(spark, d):
    return evaluate.positive_weight(table(spark, d, "labels").select(F.col("toxic").alias("label")))


@query("SELECT count(*) AS total, count(DISTINCT sha1(text)) AS distinct_uids FROM documents")
def unique_vs_total(spark, d):
    return sets.unique_vs_total(table(spark, d, "documents").select(F.sha1("text").alias("uid")))


_BINS = "SELECT user_id AS item, event_id % 16 AS bin, event_id % 50 AS x, CAST(floor(event_id / 50) % 40 AS BIGINT) AS y FROM events"


@query(f"WITH q AS ({_BINS}), i AS (SELECT DISTINCT item FROM q) SELECT item, list_transform(range(0, 16), lambda b: round(len(list_filter(bins, lambda x: x = b)) / len(bins), 6)) AS histogram FROM (SELECT item, list(bin) AS bins FROM q GROUP BY item)")
def bow_histogram(spark, d):
    return evaluate.bag_of_words(_bins(spark, d), 16)


def _bins(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("item"), (e % 16).cast("int").alias("bin"), (e % 50).alias("x"), (F.floor(e / 50) % 40).alias("y"))


@query(f"""WITH q AS ({_BINS}), m AS (SELECT *, ceil(max(x) OVER w / 2) AS mx, ceil(max(y) OVER w / 2) AS my, greatest(ceil(max(y) OVER w / 3), 1) AS t FROM q WINDOW w AS (PARTITION BY item)),
r AS (SELECT item, bin, 0 AS region FROM m UNION ALL SELECT item, bin, 1 + CAST(x >= mx AS INT) + 2 * CAST(y >= my AS INT) FROM m UNION ALL SELECT item, bin, 5 + CAST(least(floor(y / t), 2) AS INT) FROM m),
c AS (SELECT item, region, bin, count(*) AS n FROM r GROUP BY ALL) SELECT item, region, CAST(bin AS INT) AS bin, round(n / sum(n) OVER (PARTITION BY item, region), 6) AS share FROM c""")
def pyramid_histogram(spark, d):
    return evaluate.pyramid(_bins(spark, d))


# A classifier's scores for curves: toxic by quality and id.

_CURVE = "SELECT doc_id % 5 AS fold, toxic AS truth, round((doc_id * 7919 % 101) / 101.0, 2) AS score FROM labels"
_CUM = "s AS (SELECT {by} score, sum(truth) AS p, sum(1 - truth) AS n FROM x GROUP BY ALL), c AS (SELECT *, sum(p) OVER ({part} ORDER BY score DESC) AS tp, sum(n) OVER ({part} ORDER BY score DESC) AS fp, sum(p) OVER ({part}) AS ap, sum(n) OVER ({part}) AS an FROM s)"
_ALL, _FOLD = _CUM.format(by="", part=""), _CUM.format(by="fold,", part="PARTITION BY fold")


def _curve(spark, d):
    return table(spark, d, "labels").select((F.col("doc_id") % 5).alias("fold"), F.col("toxic").alias("truth"), F.round((F.col("doc_id") * 7919 % 101) / 101.0, 2).alias("score"))


@query(f"WITH x AS ({_CURVE}), {_ALL} SELECT score, round(coalesce(fp / nullif(an, 0), 0), 6) AS fpr, round(coalesce(tp / nullif(ap, 0), 0), 6) AS tpr FROM c")
def roc_curve(spark, d):
    return evaluate.roc_curve(_curve(spark, d))


@query(f"WITH x AS ({_CURVE}), {_ALL} SELECT round(sum(n * (tp - p / 2)) / nullif(max(ap) * max(an), 0), 6) AS auc FROM c")
def roc_auc(spark, d):
    return evaluate.roc_auc(_curve(spark, d))


@query(f"WITH x AS ({_CURVE}), {_ALL} SELECT score, round(tp / ap, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM c")
def pr_curve(spark, d):
    return evaluate.pr_curve(_curve(spark, d))


@query(f"WITH x AS ({_CURVE}), {_ALL}, r AS (SELECT score, tp / ap AS r, tp / (tp + fp) AS q FROM c), t AS (SELECT r, q, coalesce(lag(r) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(q) OVER (ORDER BY score DESC), 1) AS q0 FROM r) SELECT round(sum((r - r0) * (q + q0) / 2), 6) AS auc FROM t")
def pr_auc(spark, d):
    return evaluate.pr_auc(_curve(spark, d))


@query(f"WITH x AS ({_CURVE}), {_FOLD} SELECT fold, round(sum(n * (tp - p / 2)) / nullif(max(ap) * max(an), 0), 6) AS auc FROM c GROUP BY fold")
def fold_auc(spark, d):
    return evaluate.roc_auc(_curve(spark, d), ["fold"])


_RANK = "row_number() OVER (PARTITION BY label ORDER BY md5('0:' || uid), uid)"


@query(f"WITH {V} SELECT uid, label, CAST(({_RANK} - 1) % 5 AS INT) AS fold FROM v")
def stratified_kfold(spark, d):
    return evaluate.stratified_folds(vectors(spark, d).select("uid", "label"), 5)


@query(f"WITH {V} SELECT uid, label, CASE WHEN {_RANK} <= round(count(*) OVER (PARTITION BY label) * 0.25) THEN 'test' ELSE 'train' END AS part FROM v")
def stratified_split(spark, d):
    return evaluate.stratified_split(vectors(spark, d).select("uid", "label"), 0.25)


@query(f"WITH {V}, p AS (SELECT label, CASE WHEN {_RANK} <= round(count(*) OVER (PARTITION BY label) * 0.25) THEN 'test' ELSE 'train' END AS part FROM v), c AS (SELECT label, part, count(*) AS n FROM p GROUP BY ALL) SELECT label, part, n, round(100 * n / sum(n) OVER (PARTITION BY label), 6) AS percent FROM c")
def split_counts(spark, d):
    return evaluate.split_counts(evaluate.stratified_split(vectors(spark, d).select("uid", "label"), 0.25))


@query("WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), r AS (SELECT conv_id, ['train1', 'train2', 'train3', 'test'][(row_number() OVER (ORDER BY n DESC, conv_id DESC) - 1) % 4 + 1] AS part FROM s) SELECT conv_id, turn, part FROM conversations JOIN r USING (conv_id)")
def size_ranked_split(spark, d):
    return evaluate.size_ranked_split(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id")


# Learning and refinement.

_NAMES = [f"label_{i}" for i in range(64)]


@query(f"WITH {V}, u AS (SELECT uid, 'label_' || unnest(range(0, 64)) AS label, unnest(vector) AS confidence FROM v) SELECT uid, label, confidence FROM u")
def index_label_classifier(spark, d):
    return learn.index_label(vectors(spark, d).drop("label"), _NAMES).select("uid", F.explode("scores").alias("label", "confidence"))


def _fixed_models() -> dict[str, learn.LinearModel]:
    return {"a": learn.LinearModel(["neg", "pos"], [[0.0] * 64, _COLUMNS[0]], [0.0, 0.25]), "b": learn.LinearModel(["neg", "pos"], [[0.0] * 64, _COLUMNS[1]], [0.0, -0.25])}


def _logit(c: int, bias: float) -> str:
    return f"round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: vector[i] * ({[int(x) for x in _COLUMNS[c]]})[i])) + ({bias})))), 6)"


@query(f"WITH {V} SELECT 'a' AS classifier, uid, {_logit(0, 0.25)} AS positive FROM v UNION ALL SELECT 'b', uid, {_logit(1, -0.25)} FROM v")
def classifier_collection(spark, d):
    return learn.collection(vectors(spark, d), _fixed_models()).select("classifier", "uid", F.round(F.element_at("scores", "pos"), 6).alias("positive"))


@query(f"WITH {V}, s AS (SELECT uid, {_logit(0, 0.25)} AS score FROM v) SELECT uid, score, round(abs(score - 0.5), 6) AS gap FROM s ORDER BY gap, uid LIMIT 10")
def rank_margin_feedback(spark, d):
    scores = vectors(spark, d).select("uid", F.round(F.element_at(_fixed_models()["a"].scores(F.col("vector")), "pos"), 6).alias("score"))
    return learn.margin_feedback(scores, 10, digits=6)


@query(f"WITH {H}, p AS (SELECT b.uid, row_number() OVER (PARTITION BY a.uid ORDER BY {HIK} DESC, b.uid) AS r FROM h a JOIN h b ON a.uid % {EVERY} = 0) SELECT DISTINCT uid FROM p WHERE r <= 2")
def auto_negatives(spark, d):
    rows = histograms(spark, d)
    return learn.auto_negatives(rows.where(F.col("uid") % EVERY == 0), rows, 2)


@query(f"WITH {_ranked(V, 'v', L2, 10)[5:].replace('SELECT qid, uid, dist, CAST(rank AS INT) AS rank FROM', 'SELECT DISTINCT uid FROM')}")
def seed_working_set(spark, d):
    rows = vectors(spark, d)
    return iqr.working_set(asked(rows), rows, 10, digits=6)


@query(f"WITH {V}, k AS (SELECT uid AS bin, vector FROM v WHERE uid < 8), p AS (SELECT b.uid AS item, a.bin, row_number() OVER (PARTITION BY b.uid ORDER BY list_sum(list_transform(range(1, 65), lambda i: (b.vector[i] - a.vector[i]) * (b.vector[i] - a.vector[i]))), a.bin) AS r FROM v b CROSS JOIN k a) SELECT item, CAST(bin AS INT) AS bin, CAST(r AS INT) AS rank FROM p WHERE r <= 2")
def quantise_codebook(spark, d):
    rows = vectors(spark, d)
    book = [r["vector"] for r in rows.where("uid < 8").orderBy("uid").collect()]
    return learn.quantise(rows.select(F.col("uid").alias("item"), "vector"), book, 2)


@query()
def iqr_refine(spark, d):
    session = iqr.Session(histograms(spark, d).select("uid", "vector"), neighbours=40, by="hik")
    session.adjudicate(new_pos=[0, 1], new_neg=[2, 3])
    session.update_working_set()
    session.refine()
    return session.ordered()


@query()
def hik_relevancy(spark, d):
    rows = histograms(spark, d)
    return learn.intersection_relevancy(rows.select("uid", "vector"), rows.where("uid in (0, 5)").select("uid", "vector"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TEXTS = "d AS (SELECT DISTINCT sha1(text) AS uid, lower(text) AS t FROM documents WHERE length(text) > 0)"
_SHARES = ", ".join(f"round((length(t) - length(replace(t, '{c}', ''))) / length(t), 6)" for c in _LETTERS)


def _elements(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.sha1("text").alias("uid"), F.col("text").cast("binary").alias("content"), F.lit("text/plain").alias("content_type"), (F.col("doc_id") % 3).alias("third"))


def _rounded(column: str):
    return F.transform(column, lambda x: vec.rounded(x))


@query(f"WITH {_TEXTS}, o AS (SELECT DISTINCT sha1(text) AS uid FROM documents WHERE doc_id % 3 = 0 AND length(text) > 0) SELECT uid, CASE WHEN uid IN (SELECT uid FROM o) THEN [1.0::DOUBLE] ELSE [{_SHARES}] END AS vector FROM d")
def compute_many_descriptors(spark, d):
    """What a third of the documents have already stays, the others are described, each content once."""
    elements = _elements(spark, d)
    done = elements.where("third = 0 and octet_length(content) > 0").select("uid", F.array(F.lit(1.0)).alias("vector")).distinct()
    return descriptors.compute(elements, descriptors.Letters(), done).select("uid", _rounded("vector").alias("vector"))


_TWICE = "unnest(['whole', 'half']) AS transform"


@query(f"WITH {_TEXTS}, x AS (SELECT uid, 'whole' AS transform, t FROM d UNION ALL SELECT uid, 'half', left(t, CAST(length(t) // 2 AS INT)) FROM d) SELECT uid, transform, [{_SHARES}] AS vector FROM x WHERE length(t) > 0")
def transformed_descriptors(spark, d):
    text_of = lambda c: c.cast("string")
    transforms = {"whole": lambda c: c, "half": lambda c: F.substring(text_of(c), F.lit(1), F.floor(F.char_length(text_of(c)) / 2).cast("int"))}
    return descriptors.compute_transformed(_elements(spark, d), transforms, descriptors.Letters()).select("uid", "transform", _rounded("vector").alias("vector"))


@query()
def svm_classify(spark, d):
    rows = vectors(spark, d)
    model = learn.linear_svm(rows.where("uid % 2 = 0").select("vector", "label"))
    return learn.classify(rows.where("uid % 2 = 1"), model).select("uid", F.map_keys("scores").alias("labels"), F.transform(F.map_values("scores"), lambda x: F.round(x, 6)).alias("confidences"))


#: Rows of which the pairwise machines are fitted, at most about.
SVM_ROWS = 1000


@query()
def csvc_classify(spark, d):
    """Coupled probabilities of pairwise machines with a radial kernel, fitted on a sample drawn by hash."""
    rows = vectors(spark, d)
    share = F.pmod(F.xxhash64("uid", F.lit("svm")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    model = svm.fit(rows.where(share < SVM_ROWS / max(1, rows.count())).limit(2 * SVM_ROWS).select("vector", "label"), svm.Kernel("rbf"))
    scored = svm.classify(rows, model)
    return scored.select("uid", F.map_keys("scores").alias("labels"), F.transform(F.map_values("scores"), lambda x: F.round(x, 6)).alias("confidences"))


@query()
def kfold_validation(spark, d):
    """Areas under the curves of classifiers that were fitted on the other folds."""
    scores = evaluate.cross_validated(vectors(spark, d), learn.logistic, 3)
    return evaluate.roc_auc(evaluate.one_vs_rest(scores), ["label"])


@query(f"WITH {V}, s AS (SELECT uid, {_logit(0, 0.25)[6:-4]} AS p FROM v) SELECT uid, round(p * exp(-1.0) / (p * exp(-1.0) + (1 - p)), 5) AS positive FROM s")
def adjusted_classification(spark, d):
    scored = learn.classify(vectors(spark, d), _fixed_models()["a"])
    return learn.adjusted_scores(scored, {"pos": 1.0}, negate=True).select("uid", F.round(F.element_at("scores", "pos"), 5).alias("positive"))


@query()
def logreg_classify(spark, d):
    rows = vectors(spark, d)
    model = learn.logistic(rows.where("uid % 2 = 0").select("vector", "label"))
    return learn.classify(rows.where("uid % 2 = 1"), model).select("uid", F.map_keys("scores").alias("labels"), F.transform(F.map_values("scores"), lambda x: F.round(x, 6)).alias("confidences"))


@query()
def kmeans_clusters(spark, d):
    return learn.clusters(vectors(spark, d), 10)


# Streams as tables.


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_expiry(spark, d):
    out = incremental.sessions(table(spark, d, "events"), "30 minutes")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


@query("WITH x AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t FROM events) SELECT user_id AS key, event_id, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 3600, false) AS hit FROM x")
def ttl_cache_hits(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "ts")
    return incremental.cache_hits(rows, 3600).select("key", "event_id", "hit")


@query("SELECT event_id FROM events WHERE ts > (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)")
def high_water_mark(spark, d):
    rows = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    return incremental.since(rows, F.timestamp_micros(F.lit(low + (high - low) // 2)), F.timestamp_micros(F.lit(high))).select("event_id")


@query(f"WITH {CODED} SELECT uid, CASE WHEN uid % 5 = 0 THEN xor(code, 1) ELSE code END AS code FROM c WHERE uid % 3 = 0 OR uid % 5 = 0")
def incremental_index_merge(spark, d):
    rows = coded(spark, d).select("uid", "code")
    return incremental.merged(rows.where("uid % 3 = 0"), rows.where("uid % 5 = 0").withColumn("code", F.col("code").bitwiseXOR(F.lit(1))))


@query("SELECT event_id FROM events WHERE epoch_us(ts) < (SELECT max(epoch_us(ts)) FROM events) - 86400 * 1000000::BIGINT")
def age_out(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("modified"))
    now = rows.agg(F.max("modified")).first()[0]
    return files.older_than(rows, 86400, F.lit(now)).select("event_id")


# Strings, boxes, grids and formats.


@query("SELECT doc_id, sha1(text) AS uid, md5(text) AS md5 FROM documents")
def sha1_uid(spark, d):
    ids = text.content_ids(F.col("text"))
    return table(spark, d, "documents").select("doc_id", ids["uid"].alias("uid"), ids["md5"].alias("md5"))


@query("WITH s AS (SELECT doc_id, sha1(text) AS u FROM documents) SELECT doc_id, list_transform(range(0, 7), lambda i: substr(u, CAST(i * 5 + least(i, 5) + 1 AS INT), CASE WHEN i < 5 THEN 6 ELSE 5 END)) AS parts FROM s")
def partition_uid(spark, d):
    return table(spark, d, "documents").select("doc_id", text.partition(F.sha1("text"), 7).alias("parts"))


@query("SELECT page_id, 'http://host/api/' || page_id AS a, '/x' || page_id AS b, 'http://host/api/' AS c, coalesce(rtrim(url, '/'), 'http://host/api/') AS d FROM pages")
def url_join(spark, d):
    base, n = F.lit("http://host/api"), F.col("page_id").cast("string")
    return table(spark, d, "pages").select("page_id", text.url_join(base, n).alias("a"), text.url_join(base, F.concat(F.lit("/x"), n)).alias("b"), text.url_join(base, F.lit("")).alias("c"), text.url_join(base, F.coalesce("url", F.lit(""))).alias("d"))


@query("SELECT item_id, sha1(text) AS uid, 'text/plain' AS content_type FROM benchmark")
def base64_elements(spark, d):
    uri = F.concat(F.lit("data:text/plain;base64,"), text.to_base64_url(F.col("text").cast("binary")))
    rows = table(spark, d, "benchmark").select("item_id", uri.alias("uri"))
    found = files.memory_elements(rows.select("uri")).distinct()
    return rows.select("item_id", F.sha1(text.from_base64_url(F.regexp_extract("uri", "(?s)base64,(.*)$", 1))).alias("uid")).join(found, "uid").select("item_id", "uid", "content_type")


@query("SELECT page_id, CASE WHEN url LIKE '%.html' THEN 'text/html' END AS content_type FROM pages WHERE url LIKE '%.html'")
def content_type_filter(spark, d):
    rows = table(spark, d, "pages").select("page_id", text.content_type(F.col("url")).alias("content_type"))
    return files.of_type(rows, ["text/html"])


@query("SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN 'url' END AS source FROM pages")
def uri_route(spark, d):
    return table(spark, d, "pages").select("page_id", text.source_of(F.col("url")).alias("source"))


_BOX = "SELECT o_orderkey AS uid, [CAST(o_orderkey % 7 AS DOUBLE), CAST(o_orderkey % 11 AS DOUBLE)] AS low, [CAST(o_orderkey % 7 + o_custkey % 5 AS DOUBLE), CAST(o_orderkey % 11 + o_custkey % 3 AS DOUBLE)] AS high FROM orders"


@query(f"""WITH b AS ({_BOX}), x AS (SELECT uid, low, high, [greatest(low[1], 3.0), greatest(low[2], 4.0)] AS l, [least(high[1], 8.0), least(high[2], 9.0)] AS h FROM b)
SELECT uid, CASE WHEN h[1] - l[1] > 0 AND h[2] - l[2] > 0 THEN l END AS low, CASE WHEN h[1] - l[1] > 0 AND h[2] - l[2] > 0 THEN h END AS high, (high[1] - low[1]) * (high[2] - low[2]) AS volume FROM x""")
def bbox_intersection(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(k.alias("uid"), F.array((k % 7).cast("double"), (k % 11).cast("double")).alias("low"), F.array((k % 7 + c % 5).cast("double"), (k % 11 + c % 3).cast("double")).alias("high"))
    both = geometry.intersection(F.col("low"), F.col("high"), knn.literal([3, 4]), knn.literal([8, 9]))
    return rows.select("uid", both["low"].alias("low"), both["high"].alias("high"), geometry.hypervolume(F.col("low"), F.col("high")).alias("volume"))


_IMAGES = "SELECT p_partkey AS uid, CAST(40 + p_partkey % 13 AS INT) AS width, CAST(30 + p_partkey % 7 AS INT) AS height FROM part"


def _images(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("uid"), (40 + k % 13).cast("int").alias("width"), (30 + k % 7).cast("int").alias("height"))


@query(f"WITH i AS ({_IMAGES}) SELECT uid, CAST(x AS INT) AS \"left\", CAST(y AS INT) AS top, CAST(x + 10 AS INT) AS \"right\", CAST(y + 8 AS INT) AS bottom FROM i, range(0, 60, 5) a(x), range(0, 60, 8) b(y) WHERE x + 10 <= width AND y + 8 <= height")
def crop_tiles(spark, d):
    return geometry.tiles(_images(spark, d), 10, 8, (5, 8)).select("uid", "left", "top", "right", "bottom")


@query(f"WITH i AS ({_IMAGES}) SELECT uid, CAST(k AS INT) AS i, CAST(floor(width * k / 7.0) AS INT) AS \"left\", CAST(floor(height * k / 7.0) AS INT) AS top, CAST(floor(width * (7 - k) / 7.0) AS INT) AS \"right\", CAST(floor(height * (7 - k) / 7.0) AS INT) AS bottom FROM i, range(1, 4) a(k)")
def crop_centres(spark, d):
    return geometry.centre_crops(_images(spark, d), 3).select("uid", "i", "left", "top", "right", "bottom")


@query(f"WITH i AS ({_IMAGES}), l AS (SELECT CAST(x AS INT) AS level, CAST(pow(2, x) AS INT) AS n FROM range(0, 3) a(x)) SELECT uid, level, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, CAST(floor(width * tx / n) AS INT) AS \"left\", CAST(floor(height * ty / n) AS INT) AS top, CAST(floor(width * (tx + 1) / n) AS INT) AS \"right\", CAST(floor(height * (ty + 1) / n) AS INT) AS bottom FROM i CROSS JOIN l CROSS JOIN range(0, 4) b(tx) CROSS JOIN range(0, 4) c(ty) WHERE tx < n AND ty < n")
def crop_quadrants(spark, d):
    return geometry.quadrants(_images(spark, d), 2).select("uid", "level", "tx", "ty", "left", "top", "right", "bottom")


@query("SELECT o_orderkey AS uid, sha1(concat_ws('|', CAST(o_orderkey AS VARCHAR), printf('%.6f,%.6f,%.6f,%.6f', (o_orderkey % 7)::DOUBLE, 0.5::DOUBLE, (o_orderkey % 7 + 2)::DOUBLE, 3.25::DOUBLE), CASE WHEN o_orderkey % 2 = 0 THEN 'cat,dog' ELSE 'ant,dog' END)) AS detection FROM orders")
def detection_uids(spark, d):
    k = F.col("o_orderkey")
    low, high = F.array((k % 7).cast("double"), F.lit(0.5)), F.array((k % 7 + 2).cast("double"), F.lit(3.25))
    labels = F.array(F.lit("dog"), F.when(k % 2 == 0, F.lit("cat")).otherwise(F.lit("ant")))
    return table(spark, d, "orders").select(k.alias("uid"), text.detection_uid(k.cast("string"), low, high, labels).alias("detection"))


@query("SELECT page_id, [CAST(page_id AS VARCHAR), coalesce(url, '')] AS parts FROM pages")
def json_lists(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.to_json(F.array(F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))).alias("j"))
    return rows.select("page_id", text.json_list(F.col("j")).alias("parts"))


@query("SELECT o_orderkey AS uid, CAST(x * 4 AS INT) AS \"left\", CAST(y * 3 AS INT) AS top, CAST(x * 4 + 4 AS INT) AS \"right\", CAST(y * 3 + 3 AS INT) AS bottom FROM orders, range(0, 9) a(x), range(0, 9) b(y) WHERE x * 4 + 4 <= 8 + o_orderkey % 5 AND y * 3 + 3 <= 6 + o_orderkey % 3")
def sql_table_function(spark, d):
    sql.register(spark)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), (8 + F.col("o_orderkey") % 5).cast("int").alias("width"), (6 + F.col("o_orderkey") % 3).cast("int").alias("height"))
    return spark.sql("SELECT uid, t.* FROM (SELECT uid, crop_tiles(width, height, 4, 3) AS boxes FROM {rows}) LATERAL VIEW inline(boxes) t", rows=rows)


@query(f"WITH {V} SELECT a.uid AS qid, b.uid AS uid, round({L2}, 6) AS dist, round({COS}, 6) AS likeness FROM v a JOIN v b ON a.uid % {EVERY} = 0")
def sql_scalar_functions(spark, d):
    sql.register(spark)
    rows = vectors(spark, d)
    return spark.sql("SELECT /*+ BROADCAST(q) */ qid, uid, round(euclidean_distance(vector, qvector), 6) AS dist, round(cosine_likeness(vector, qvector), 6) AS likeness FROM {rows} CROSS JOIN {q} q", rows=rows, q=asked(rows))


@query("""WITH k AS (SELECT p_partkey AS uid, p_size % 19 AS n FROM part), c AS (SELECT uid, n, uid % (n + 1) AS r FROM k)
SELECT CAST(uid AS BIGINT) AS uid, CAST(n AS BIGINT) AS n, CAST(r AS BIGINT) AS r, CAST(factorial(CAST(n AS INT)) / (factorial(CAST(r AS INT)) * factorial(CAST(n - r AS INT))) AS BIGINT) AS ways FROM c""")
def n_choose_r(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("uid"), (F.col("p_size") % 19).cast("bigint").alias("n")).withColumn("r", F.col("uid") % (F.col("n") + 1))
    return rows.withColumn("ways", numbers.binomial(F.col("n"), F.col("r")))


@query("""WITH k AS (SELECT p_partkey AS n, range(1, CAST(floor(sqrt(p_partkey)) AS BIGINT) + 1) AS small FROM part)
SELECT n, n > 1 AND len(list_filter(small, lambda x: x > 1 AND n % x = 0)) = 0 AS prime, len(list_filter(small, lambda x: n % x = 0)) AS pairs FROM k""")
def primes_and_factors(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("n"))
    return rows.select("n", numbers.is_prime(F.col("n")).alias("prime"), F.size(numbers.factor_pairs(F.col("n"))).cast("bigint").alias("pairs"))


@query(f"WITH {V}, f AS (SELECT label, row_number() OVER (ORDER BY min(uid)) AS number FROM v GROUP BY label) SELECT uid, CAST(number AS VARCHAR) AS label, list_transform(vector, lambda x: round(x, 6) + 0.0) AS vector FROM v JOIN f USING (label)")
def libsvm_roundtrip(spark, d):
    lines = files.libsvm_lines(vectors(spark, d))
    return files.parse_libsvm(lines, 64).select("uid", "label", F.transform("vector", lambda x: F.round(x, 6) + 0.0).alias("vector"))


@query(f"WITH {V} SELECT uid, list_transform(vector, lambda x: round(x, 6) + 0.0) AS vector FROM v")
def csv_vectors(spark, d):
    lines = vectors(spark, d).select("uid", F.array_join(F.transform("vector", lambda x: x.cast("string")), ",").alias("value"))
    return files.parse_csv_vectors(lines).select("uid", F.transform("vector", lambda x: F.round(x, 6) + 0.0).alias("vector"))
