"""License templates, whitening and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import licenses, variants, whitening

DOCS = "doc_id bigint, text string"


# Licenses


def brute_places(template, words):
    """Longest place of each start, by regular expressions over every stretch."""
    pattern = re.compile(licenses.as_regex(template)[:-1])
    out = []
    for a in range(len(words)):
        ends = [b for b in range(a + 1, len(words) + 1) if pattern.fullmatch("".join(" " + w for w in words[a:b]))]
        if ends:
            out.append((a, max(ends)))
    return out


MADE = [licenses.Template("x", "a [b] c"), licenses.Template("y", "a {1-3} c [{b|c a} b]"), licenses.Template("z", "b {a|b c} [c [a]] b", "base", 0.5), licenses.Template("w", "[c] b {0-2} b")]


@pytest.mark.parametrize("most", [20_000, 3])
def test_places_equal_brute_force(monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_STATES", most)
    rng = random.Random(1)
    machine = licenses.Automaton(MADE)
    seen = 0
    for _ in range(300):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        got = machine.places(words)
        for k, t in enumerate(MADE):
            every = brute_places(t, words)
            mine = [(a, b) for a, b, j in got if j == k]
            # A place is told by its end and the least start there; of equal starts the longest is kept.
            pattern = re.compile(licenses.as_regex(t)[:-1])
            least = {}
            for b in range(1, len(words) + 1):
                starts = [a for a in range(b) if pattern.fullmatch("".join(" " + w for w in words[a:b]))]
                if starts:
                    least[min(starts)] = b
            assert mine == sorted(least.items())
            assert bool(every) == bool(mine)
            seen += len(mine)
    assert seen > 300


def test_markup():
    for text in ("a ]", "[a", "[a]", "{0-3}", ""):
        with pytest.raises(ValueError):
            licenses.Automaton([licenses.Template("t", text)])
    mit = next(t for t in licenses.TEXTS if t.label == "mit")
    wording = re.sub(r"\{0-20\}", "2020 Some Holder", mit.markup).replace("{the authors or copyright holders|the copyright holders|the authors}", "the authors").replace("[", "").replace("]", "")
    words = licenses.words_of("Before it. " + wording + " After.")
    machine = licenses.Automaton(licenses.TEMPLATES)
    assert [(licenses.TEMPLATES[k].label, licenses.TEMPLATES[k].kind, a, b) for a, b, k in machine.places(words)] == [("mit", "text", 2, len(words) - 1)]
    assert machine.places(licenses.words_of(wording.replace("free of charge", "for a fee"))) == []


def test_license_rows(spark):
    long = "word " * 100_000 + "under the MIT license, Licensed under the Apache License, Version 2.0"
    texts = ["Released under the MIT License. under the mit license", "CC BY-NC 4.0", None, "", " \n", "This work is licensed under the GNU General Public License, version 3.", "ünder the mit license", long]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(f"clash {c}") for c in ("places", "n_words", "label", "kind", "score", "start", "end")})
    out = licenses.digest(licenses.scan(table, licenses.TEMPLATES))
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter(
        {
            (0, 9, 2, 1, 5, "mit", "mit", 0.8): 2, (1, 5, 1, 0, 0, "cc-by-nc", "cc-by-nc", 0.5): 1, (None, 5, 1, 0, 0, "cc-by-nc", "cc-by-nc", 0.5): 1, (2, 0, 0, None, None, "", "", 0.0): 1, (3, 0, 0, None, None, "", "", 0.0): 1,
            (4, 0, 0, None, None, "", "", 0.0): 1, (5, 12, 0, None, None, "", "gpl-3", 0.8): 1, (6, 4, 0, None, None, "", "", 0.0): 1, (7, 100_012, 2, 100_000, 100_007, "apache-2,mit", "apache-2,mit", 0.8): 1,
        }
    )
    assert licenses.digest(licenses.scan(table.limit(0), licenses.TEMPLATES)).count() == 0


# Whitening


def brute_whitening(vectors, wanted=16):
    """From exact integers: covariance as fractions of big integers, eigenvectors by LAPACK."""
    x = np.array(sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors}), object)
    n, sums = len(x), x.sum(0)
    away = x * n - sums
    v = (away.T.dot(away)).astype(np.float64) / float(n) ** 3
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:wanted]
    return n, sums, values[order], axes[:, order], np.trace(v)


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, x string, n string, component string")


@pytest.mark.parametrize("fan", [32, 2])
def test_whitening_equals_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN", fan)
    rng = np.random.default_rng(3)
    plain = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    rows = [(i, v.tolist(), "clash", None, "") for i, v in enumerate(plain)]
    rows += [(1000, plain[0].tolist(), "", "", ""), (None, plain[1].tolist(), "", "", ""), (7, plain[7].tolist(), "", "", "")]
    rows += [(2000, None, "", "", ""), (2001, [float("nan")] * 20, "", "", ""), (2002, [None] + [0.0] * 19, "", "", ""), (2003, [float("-inf")] * 20, "", "", ""), (2004, [], "", "", "")]
    out = whitening.whiten(vectors_table(spark, rows).repartition(9), "vec_id", "embedding").collect()
    n, sums, values, axes, trace = brute_whitening(plain)
    assert len(out) == 303 * 16 and {r["n"] for r in out} == {n} and len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-10
    by = {}
    for r in out:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert Counter(len(x) for (i, _), x in by.items() if i == 7) == {2: 16}
    signs = None
    for i, v in enumerate(plain):
        x = np.array([math.floor(64 * float(c)) + 1_000_000 for c in v], object)
        away = x * n - sums
        want = (away.astype(np.float64) / n) @ axes / np.sqrt(values)
        got = [by[i, k][0] for k in range(1, 17)]
        assert {r["deviation"] for r in got} == {(away * away).sum()}
        white = np.array([r["whitened"] for r in got])
        signs = np.sign(white * want) if signs is None else signs
        assert np.abs(white * signs - want).max() < 1e-8
        assert np.abs(np.array([r["explained"] for r in got]) / (values / trace) - 1).max() < 1e-9


def test_whitening_at_the_edges(spark):
    run = lambda rows: whitening.whiten(vectors_table(spark, rows), "vec_id", "embedding").collect()
    assert run([(1, None, "", "", "")]) == [] and whitening.whiten(vectors_table(spark, [(1, None, "", "", "")]).limit(0), "vec_id", "embedding").count() == 0
    one = run([(1, [0.5, 1.0], "", "", ""), (2, [0.5, 1.0], "", "", "")])
    assert len(one) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None) for r in one)
    # Widths are fitted apart; a direction without variance has no whitened value.
    mixed = run([(1, [0.0, 1.0, 5.0], "", "", ""), (2, [1.0, 0.0, 5.0], "", "", ""), (3, [0.0, 0.0, 5.0], "", "", ""), (4, [1.0], "", "", ""), (5, [3.0], "", "", "")])
    wide = [r for r in mixed if r["vec_id"] < 4]
    assert len(mixed) == 11 and {r["n"] for r in wide} == {3} and [r["whitened"] is None for r in wide if r["vec_id"] == 1] == [False, False, True] and wide[0]["identity_error"] < 1e-12
    narrow = {r["vec_id"]: r for r in mixed if r["vec_id"] > 3}
    assert {narrow[4]["whitened"], narrow[5]["whitened"]} == {1.0, -1.0} and narrow[4]["deviation"] == 128**2 and narrow[4]["explained"] == 1.0
    huge = run([(1, [3.0e38], "", "", ""), (2, [-3.0e38], "", "", "")])
    assert {r["deviation"] for r in huge} == {None} and {round(r["whitened"], 12) for r in huge} == {1.0, -1.0}


def test_symmetric_qr():
    rng = np.random.default_rng(0)
    made = [np.zeros((3, 3)), np.eye(4), np.ones((5, 5)), np.diag([1.0, 2, 3]), np.array([[2.0]]), np.diag([1e-300, 1e300])]
    for d in (2, 3, 17, 64):
        a = rng.normal(size=(d, d))
        made += [a @ a.T, a + a.T, np.outer(a[0], a[0])]
    for a in made:
        values, axes = whitening.symmetric_qr(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(values / size - np.linalg.eigvalsh(a / size)[::-1]).max() < 1e-12 * len(a) and (np.diff(values) <= 0).all()
        assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-12 and np.abs(a / size @ axes - axes * (values / size)).max() < 1e-12 * len(a)


# Spelling variants


def one_apart(a, b):
    return a != b and (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or any(x[:i] + x[i + 1 :] == y for x, y in ((a, b), (b, a)) for i in range(len(x))))


def brute_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_near_words_equal_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))) for _ in range(900)} | {"a" * k for k in range(5, 40)} | {"ab" * 300, "ab" * 300 + "a", "b" + "ab" * 300})
    want = {(a, b) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and one_apart(a, b)}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    for block in (1024, 8):
        monkeypatch.setattr(variants, "BLOCK", block)
        got = [tuple(sorted((r["a"], r["b"]))) for r in variants.near_words(table).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 1000


def test_overlap_bound():
    """No pair one edit apart shares fewer bigrams at places that differ by at most 1 than the filter asks for."""
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("aab") for _ in range(rng.randint(5, 9)))
        i, letter = rng.randrange(len(word)), rng.choice("abc")
        other = rng.choice([word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])
        if other == word or len(other) < 5:
            continue
        long, short = sorted((word, other), key=len)[::-1]
        assert list(variants._near([long, short], [0, 0], len(long), True)) in ([(0, 1)], [(1, 0)])


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghéÉ×") for _ in range(rng.randint(4, 8))) for _ in range(25)]
    vocabulary = base * 6
    for w in base * 4:
        i = rng.randrange(len(w))
        vocabulary += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("aeX") + w[i:], w.upper()])] * rng.randint(1, 3)
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", "1", "-Ā"]) for _ in range(60))) for i in range(120)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (500, None), (501, ""), (502, "word " * 20_000 + "x" * 50_000)]
    table = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("word", "n", "key", "form", "root", "first")})
    got = variants.group_variants(variants.count_words(table)).collect()
    assert len(got) == len({r["word"] for r in got}) and {tuple(r) for r in got} == brute_variants(rows)
    assert any(r["form"] for r in got) and any(r["root"] != r["form"] for r in got if r["form"])
    assert variants.group_variants(variants.count_words(table.limit(0))).count() == 0
