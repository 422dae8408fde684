"""Language identification, toxicity scores and sharding held against plain definitions."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import graph, langid, sharding, toxicity


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def _ppm_bits(trained, text, used):
    """Code length of a text by PPM-C with exclusion, order 3 to 0, from the texts of one language."""
    other = 256
    symbol = lambda b: b if b in used else other
    counts = {}
    for t in trained:
        whole = [other] * 3 + [symbol(b) for b in t]
        for i in range(3, len(whole)):
            for k in range(4):
                counts.setdefault(tuple(whole[i - k : i]), Counter())[whole[i]] += 1
    total, whole = 0.0, [other] * 3 + [symbol(b) for b in text]
    for i in range(3, len(whole)):
        escape, gone, p = 1.0, set(), None
        for k in (3, 2, 1, 0):
            seen = {s: c for s, c in counts.get(tuple(whole[i - k : i]), {}).items() if s not in gone}
            n, q = sum(seen.values()), len(seen)
            if whole[i] in seen:
                p = escape * seen[whole[i]] / (n + q)
                break
            if n:
                escape *= q / (n + q)
            gone |= set(seen)
        total -= math.log2(p if p is not None else escape / (256 - len(gone)))
    return total


def test_language_code_lengths(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(3, 12), "abcde é" if i % 3 else "cdefg "), ["a", "b", "b"][i % 3]) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(table, rows_per_language=10_000, least=1)
    by = {x: [t.encode() for _, t, y in rows if y == x] for x in "ab"}
    used = {b for texts in by.values() for t in texts for b in t}
    asked = [words(rng, 6, "abcdefgé "), "zzz abc", "a", "ü", "cde cde cde " * 20]
    got = langid.score_bits(model, [t.encode() for t in asked])
    want = [[_ppm_bits(by[x], t.encode(), used) for x in model.languages] for t in asked]
    assert model.languages == ["a", "b"] and np.allclose(got, want, rtol=1e-4)
    tagged = langid.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, t, bits in zip(tagged, asked, want, strict=True):
        n = len(t.encode())
        assert r["lang_pred"] == model.languages[int(np.argmin(bits))] and r["bits"] == pytest.approx(min(bits), rel=1e-4)
        assert r["score"] == pytest.approx(1 / sum(2 ** ((min(bits) - b) * min(n, 32) / n) for b in bits), rel=1e-3)


def test_document_scores_by_enumeration(spark):
    """Marginals of every token from all labellings of its sentence, and the score from their summary."""
    rng = random.Random(9)
    bad = ["grok", "zorb"]
    rows = []
    for i in range(240):
        w = words(rng, 12).split()
        if i % 4 == 0:
            w[rng.randrange(12)] = rng.choice(bad)
        rows.append((i, " ".join(w) + "."))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(0, 0), (0, 1)], "doc_id bigint, toxic int")
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit(table, labels)
    asked = ["grok ab cd. ef gh zorb!", "ab cd ef gh.", "Grok", "x. y? z", ""]
    got = toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, asked, strict=True):
        tokens, found = text.lower().split(), []
        lengths = toxicity.sentences(tokens) if tokens else []
        emissions = model.chain.weights[toxicity._features(tokens, lengths)].sum(1) if tokens else np.zeros((0, 2))
        at = 0
        for n in lengths:
            e, at = emissions[at : at + n], at + n
            mass = np.zeros((n, 2))
            for y in product((0, 1), repeat=n):
                weight = math.exp(model.chain.first[y[0]] + sum(e[i][y[i]] for i in range(n)) + sum(model.chain.moves[a][b] for a, b in zip(y, y[1:], strict=False)))
                for i in range(n):
                    mass[i, y[i]] += weight
            found += (mass[:, 1] / mass.sum(1)).tolist()
        m = np.array(found)
        summary = np.array([max(found, default=0.0), math.log1p(m.sum()), 10 * m.sum() / (len(found) + 10), math.log((m.sum() + 0.1) / (len(found) + 20))])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(summary @ model.slope + model.bias))), abs=1e-6)
        assert [text[s["start"] : s["end"]] for s in r["spans"]] == [t for t, p in zip(text.split(), found, strict=True) if p >= 0.5]
    held = toxicity.score(table.where("doc_id >= 200"), model).select(((F.col("score") >= 0.3) == (F.col("doc_id") % 4 == 0)).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert held >= 0.9


def test_shards_cut_few_links(spark):
    """Pairs of equal texts in different shards, against propagation in plain Python under the same quotas, and against no propagation."""
    rng = random.Random(10)
    texts = [words(rng, 4) for _ in range(300)]
    for k in range(60):
        texts += [f"group {k}"] * rng.randint(2, 9)
    texts += ["big"] * 100 + ["huge"] * 250
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sharding.shard(table, 16).collect()

    def cut(place):
        groups = {}
        for text, s in place:
            groups.setdefault(text, Counter())[s] += 1
        return sum((sum(c.values()) ** 2 - sum(n * n for n in c.values())) // 2 for c in groups.values())

    target = [len(texts) // 16 + (s < len(texts) % 16) for s in range(16)]
    members = {}
    for i, t in enumerate(texts):
        members.setdefault(t, []).append(i)
    linked = [i for g in members.values() if len(g) > 1 for i in g]
    shard = {i: rng.randrange(16) for i in range(len(texts))}
    start = cut([(texts[i], s) for i, s in shard.items()])
    held = Counter(shard[i] for i in linked)
    for _ in range(24):
        for i in rng.sample(linked, len(linked)):
            near = Counter(shard[j] for j in members[texts[i]] if j != i)
            best = max((s for s in near if s == shard[i] or held[s] < target[s]), key=lambda s: (near[s], -s), default=shard[i])
            if near[best] > near[shard[i]]:
                held[shard[i]] -= 1
                held[best] += 1
                shard[i] = best
    reference, found = [(texts[i], s) for i, s in shard.items()], [(texts[r["doc_id"]], r["shard"]) for r in rows]
    small = lambda place: cut([(t, s) for t, s in place if t.startswith("group")])
    assert cut(found) <= 1.1 * cut(reference) < start and small(found) <= max(small(reference), 10)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(rows) == len(texts)


def test_equal_rows_are_split(spark):
    """A third of the rows with one id and text: they fill shards one after the other and every slot once."""
    table = spark.createDataFrame([(7, "same")] * 400 + [(i, f"text {i}") for i in range(800)], "doc_id bigint, text string")
    rows = sharding.shard(table, 16).collect()
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(75))


def test_components(spark):
    """Random graphs, stars, descending and mixed chains, loops and repeated edges, against union by hand."""
    rng = random.Random(15)
    edges = [(0, 0), (5, 5)] + [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(200, 300)]
    chain = list(range(300, 400))
    rng.shuffle(chain)
    edges += list(zip(chain, chain[1:], strict=False)) + [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(170)]
    edges += edges[:50]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = [tuple(r) for r in graph.components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in linked)
    assert graph.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0
