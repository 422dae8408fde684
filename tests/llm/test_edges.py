"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm import fingerprint, langid, minhash, mixing, multiindex, pieces, secretscan, sharding, toxicity, urlrules

MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["id", "key", "part", "row", "cls", "score", "spans", "ids", "shard", "slot", "domain", "tokens", "budget", "component_id", "kept", "next", "print", "bit", "set", "lang_pred", "toxic", "a", "b", "n", "copies", "times", "_domain", "bits", "epoch", "upto", "language", "origin", "text_key", "seat", "place", "start"]


def rows(spark):
    long = "word " * 30_000 + "x" * 70_000
    data = [(1, "the same words of a text", "en", "s1", 5), (1, "the same words of a text", "en", "s1", 5), (2, "the same words of a text", "en", "s1", 5), (1, "another text for one id", "en", None, None), (None, "no id at all here", None, "s2", None), (None, None, None, None, None), (None, None, None, None, None), (3, None, "fr", "s1", 0), (4, "", "fr", "s1", 0), (5, " \t\n", "fr", "s1", 3), (6, long, "en", "s9", len(long)), (7, "a", "en", "s9", 1)]
    return spark.createDataFrame(data, SCHEMA)


def clashing(table):
    return table.withColumns({c: F.lit(f"clash {c}") for c in CLASHES})


def operators(spark):
    from affinis.llm.crf import Chain  # noqa: F401

    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    return {
        "pieces": lambda d: pieces.encode(d, MODEL.read_bytes()), "language": lambda d: langid.identify(d, langid.fit(d)), "tag": lambda d: langid.tag(d, langid.fit(d)),
        "secrets": lambda d: secretscan.digest(secretscan.scan(d, secretscan.fit(d))), "redact": lambda d: secretscan.redact(d, secretscan.fit(d)), "near": lambda d: minhash.near_duplicates(d, 3, 85),
        "shards": lambda d: sharding.shard(d, 16), "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels)), "fingerprints": fingerprint.fingerprints,
    }


@pytest.mark.skipif(not MODEL.exists(), reason="no tokenizer files")
@pytest.mark.parametrize("name", ["pieces", "language", "tag", "secrets", "redact", "near", "shards", "toxicity", "fingerprints"])
def test_one_row_for_each(spark, name):
    run = operators(spark)[name]
    assert run(clashing(rows(spark))).count() == 12
    assert run(rows(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", ["language", "secrets", "shards", "toxicity", "fingerprints"])
def test_values_at_the_edges(spark, name):
    """Other columns change nothing; repeated rows, null ids, null, blank and very long texts get defined values."""
    run = operators(spark)[name]
    table = rows(spark)
    plain = run(table).collect()
    key = lambda r: repr(tuple(r))
    if name != "shards":  # slots follow the seats of the rows
        assert sorted(map(key, run(clashing(table)).select(*plain[0].asDict()).collect())) == sorted(map(key, plain))
    by = {}
    for r in plain:
        by.setdefault(r["doc_id"], []).append(r)
    assert {i: len(x) for i, x in by.items()} == {1: 3, 2: 1, None: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    null, empty, blank, long = (by[i][0] for i in (3, 4, 5, 6))
    if name == "language":
        assert all((r["lang_pred"], r["score"], r["bits"]) == ("und", 0.0, None) for r in (null, empty, blank))
        assert long["lang_pred"] in ("en", "fr") and sorted(r["lang_pred"] == "und" for r in by[None]) == [False, True, True]
        assert len({tuple(r) for r in by[1]}) == 2
    if name == "secrets":
        none = hashlib.sha256(b"").hexdigest()
        assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) == (0, 0, 0, none, "") for r in plain)
        assert list(plain[0].asDict())[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    if name == "shards":
        assert [null["size"], empty["size"], blank["size"], long["size"]] == [1, 1, 4, len("word ") * 30_000 + 70_001]
        assert sorted(r["size"] for r in by[None]) == [1, 1, 18] and sorted((r["shard"], r["slot"]) for r in plain) == [(s, 0) for s in range(12)]
    if name == "toxicity":
        assert all(r["spans"] == [] and 0 <= r["score"] <= 1 for r in (null, empty, blank)) and 0 <= long["score"] <= 1
        assert null["score"] == empty["score"] == blank["score"]
    if name == "fingerprints":
        assert [r["n_chars"] for r in (null, empty, blank)] == [0, 0, 3] and null["fingerprint"] == empty["fingerprint"] == blank["fingerprint"] == ""
        assert long["n_chars"] == 220_000 and len(long["fingerprint"].split(",")) == 64
        same = [r["fingerprint"] for r in (*by[1], *by[2])]
        assert max(map(same.count, same)) == 3


def test_repeated_ids(spark):
    got = minhash.near_duplicates(rows(spark), 3, 85).collect()
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (3, 4, 5))
    kept = minhash.drop_near_duplicates(clashing(rows(spark)), 3, 85)
    # Id 1 has two texts that are not alike: neither is lost.
    kept = kept.collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "3", "4", "5", "6", "7", "None", "None", "None"]
    assert {r["text"] for r in kept if r["doc_id"] == 1} == {"the same words of a text", "another text for one id"}


def test_mixing_edges(spark):
    mix = lambda d: mixing.mix(d, F.lit(None).cast("string"), {}, fraction=1.0, epochs=1)
    assert mix(clashing(rows(spark))).count() == 12
    assert mix(rows(spark).limit(0)).count() == 0
    twice = mixing.mix(rows(spark), F.lit("d"), {}, fraction=2.0, epochs=2)
    assert twice.count() == 24


def test_vector_edges(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, None, None)], "vec_id bigint, embedding array<double>, label int")
    got = multiindex.near_vectors(table.withColumn("cell", F.lit("x")), centroids=2).collect()
    assert len(got) == 7
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 0, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4)]
    assert multiindex.near_vectors(table.limit(0)).count() == 0


def test_url_edges(spark):
    rules = urlrules.rule_table(spark, urlrules.DEFAULT_RULES)
    pages = spark.createDataFrame([(None, "http://example.org/es/"), (1, None), (1, None)], "page_id bigint, url string").withColumn("rule", F.lit("clash"))
    got = urlrules.judge(pages, rules).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got) == [("1", "allow"), ("1", "allow"), ("None", "block")]
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.skipif(not MODEL.exists(), reason="no tokenizer files")
def test_pipeline_against_brute_force(spark):
    import random

    import sentencepiece

    rng = random.Random(1)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
    texts = [" ".join(word("abcdefg" if i % 2 else "tuvwxyz") for _ in range(40)) for i in range(60)]
    texts[5] += " password=0123456789abcdef end"
    data = [(i, t, "low" if i % 2 else "high", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    data += [(60, texts[0], "high", "s0", 1), (61, texts[1].upper(), "low", "s1", 1), (62, "123 456", "low", "s1", 7), (63, None, "low", "s1", None)]
    table = spark.createDataFrame(data, SCHEMA)
    kept = table
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == table.columns
        kept = spark.createDataFrame(kept.collect(), SCHEMA)
        seen.append({r["doc_id"]: r["text"] for r in kept.collect()})
    assert set(seen[0]) == set(range(62)) and set(seen[1]) == set(range(60))
    assert "password=" not in seen[2][5] and all(seen[2][i] == texts[i] for i in range(60) if i != 5)
    count = {i: len(t.split()) for i, t in seen[2].items()}
    assert sum(count[i] for i in seen[3]) <= 0.8 * sum(count.values()) and len(seen[3]) >= 40
    library = sentencepiece.SentencePieceProcessor(model_file=str(MODEL))
    got = {r["doc_id"]: r for r in corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()}
    assert {i: list(r["ids"]) for i, r in got.items()} == {i: library.encode(t) for i, t in seen[3].items()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())


def test_language_stage_acts(spark):
    import random

    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    letters = {"low": "abcdefg", "high": "tuvwxyz"}
    data = {i: (text(letters[lang]), lang) for i, lang in ((i, ("low", "high")[i % 2]) for i in range(100))}
    data |= {101: (text(letters["high"]), None), 102: (text("абвгде"), None), 104: (text("QJKMNP"), None), 105: ("e", "low"), 106: ("123", "low"), 107: (None, "low")}
    # Ids outside the fitted rows: a text that is fitted under a label is partly learned under it.
    wrong, held = (r[0] for r in spark.range(200, 300).where(corpus_pipeline.crc_bucket("id", 5) == 0).limit(2).collect())
    data[wrong] = (text(letters["low"]), "high")
    data[held] = (text("αβγδε"), "low")
    table = spark.createDataFrame([(i, t, lang, "s1", 1) for i, (t, lang) in data.items()], SCHEMA)
    got = {r["doc_id"]: (r["text"], r["lang"]) for r in corpus_pipeline.identify_language(spark, table, "").collect()}
    clean = [*range(100), 105]
    assert {i: got.get(i) for i in clean} == {i: data[i] for i in clean}
    assert got[wrong][1] == "low" and got[101][1] == "high"
    assert set(got) == {*clean, wrong, 101}
