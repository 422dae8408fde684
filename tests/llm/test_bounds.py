"""What fits hold on the driver, and what a word that was not met before costs."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from affinis.llm import crf, langid, toxicity


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def sequences(rng, n, labels, features, size):
    lengths = rng.integers(1, 40, n)
    total = int(lengths.sum())
    return rng.integers(0, size, (total, features)), rng.integers(0, labels, total), lengths


@pytest.mark.parametrize("labels", [2, 3])
def test_training_equals_the_plain_gradient(labels, monkeypatch):
    """Sums by columns and blocks and over the features that occur are those over all."""
    monkeypatch.setattr(crf, "_PAIRS", 64, raising=False)
    rng = np.random.default_rng(labels)
    features, tags, lengths = sequences(rng, 30, labels, 4, 500)
    weights = np.repeat(rng.random(len(lengths)) + 0.5, lengths)
    got = crf.train(features, tags, lengths, 2000, labels, rounds=6, weights=weights)
    want = crf.Chain(np.zeros((2000, labels)), np.zeros((labels, labels)), np.zeros(labels))
    sums = [np.full_like(p, 1e-8) for p in (want.weights, want.moves, want.first)]
    starts = np.cumsum(lengths) - lengths
    for _ in range(6):
        slopes = [np.zeros_like(p) for p in (want.weights, want.moves, want.first)]
        alpha, beta, total = crf.forward_backward(want, emissions := want.weights[features].sum(1), lengths)
        for at, n in zip(starts, lengths, strict=True):
            for t in range(at, at + n):
                gap = (np.exp(alpha[t] + beta[t] - total[t]) - np.eye(labels)[tags[t]]) * weights[t]
                for slot in features[t]:
                    slopes[0][slot] += gap
                if t == at:
                    slopes[2] += gap
                else:
                    slopes[1] += weights[t] * np.exp(alpha[t - 1][:, None] + want.moves + (emissions[t] + beta[t])[None] - total[t])
                    slopes[1][tags[t - 1], tags[t]] -= weights[t]
        for value, g, s in zip((want.weights, want.moves, want.first), slopes, sums, strict=True):
            g = g + 3e-6 * weights.sum() * value
            s += g**2
            value -= 0.5 * g / np.sqrt(s)
    for a, b in ((got.weights, want.weights), (got.moves, want.moves), (got.first, want.first)):
        assert np.allclose(a, b, atol=1e-7)


def test_training_holds_no_table_of_all_features():
    """Per token and round less than the weights of its features, and nothing but the result of the hash's size."""
    rng = np.random.default_rng(0)
    features, tags, lengths = sequences(rng, 5000, 3, 10, 3000)
    _, mb = peak_mb(lambda: crf.train(features, tags, lengths, 1 << 18, 3, rounds=2))
    assert mb < len(tags) * 10 * 3 * 8 / 1e6 + (1 << 18) * 3 * 8 / 1e6


def test_marginals_of_two_labels_equal_those_of_the_messages():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 7, 300, 2, 0, 40, 300])
    emissions = rng.normal(0, 4, (int(lengths.sum()), 2))
    emissions[5], emissions[60], emissions[400] = (0, 900), (900, 0), (-40, 40)
    for moves in (rng.normal(0, 3, (2, 2)), np.zeros((2, 2)), np.array([[0.0, -60.0], [-30.0, 5.0]]), np.array([[0.0, -900.0], [-30.0, 5.0]])):
        chain = crf.Chain(np.zeros((1, 2)), moves, np.array([0.5, -20.0]))
        alpha, beta, total = crf.forward_backward(chain, emissions, lengths[lengths > 0])
        assert np.allclose(crf.marginals(chain, emissions, lengths), np.exp(alpha + beta - total[:, None]), atol=1e-9)
    assert crf.marginals(chain, np.zeros((0, 2)), np.array([0])).shape == (0, 2)


def test_words_of_the_same_beginning_share_its_slots(monkeypatch):
    """A word that was not met before costs its own three hashes; its beginnings and shape are added up once for all words that share them."""
    rng = np.random.default_rng(2)
    model = crf.Chain(rng.normal(0, 1, (toxicity.SIZE, 2)), rng.normal(0, 1, (2, 2)), np.zeros(2))
    words = [*[f"wording{i}x" for i in range(500)], "a", "...", "ein", "vier", "fünfte", "²³", "x1", "(word)", "\ud800q", "sechs7", "ſtraße!"]
    lengths = toxicity.sentences(words)
    want = crf.marginals(model, model.weights[toxicity._features(words, lengths)].sum(1), np.array(lengths))[:, 1]
    calls, own = [], toxicity._own
    monkeypatch.setattr(toxicity, "_own", lambda word: calls.append(word) or own(word))
    monkeypatch.setattr(toxicity, "_SHARED", 0, raising=False)
    tagger = toxicity.Tagger(model)
    for _ in range(2):  # what is shared is dropped before the second
        assert np.allclose(tagger.toxic([" ".join(words)])[0], want, atol=1e-9)
        tagger.words.clear()
    assert len(calls) < 60


def test_language_fit_holds_one_table_of_contexts(spark):
    """Of the size of the cube of the letters in use there is the table itself, of four bytes a cell."""
    letters = "".join(map(chr, range(0x80, 0x800)))
    docs = spark.createDataFrame([(i, letters[i * 9 : i * 9 + 90] + " some words", "ab"[i % 2]) for i in range(200)], "doc_id bigint, text string, lang string")
    model, mb = peak_mb(lambda: langid.fit(docs))
    size = model.symbols
    assert model.row.dtype == np.int32 and len(model.row) == size**3
    assert mb < 3 * (4 * size**3 + model.bits.nbytes) / 1e6
