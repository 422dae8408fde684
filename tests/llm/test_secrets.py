"""The secret scan's field: kinds that no pattern describes, clean texts, and decoding against whole Viterbi."""

import random

import numpy as np
import pytest

from affinis.llm import crf, secretscan

B62 = secretscan._BASE62


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def field(spark):
    rng = random.Random(3)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for i in range(400):
        find = [f'token = "{draw("0123456789abcdef", 40)}"', f"password={draw('0123456789abcdef', 18)}", f"AKIA{draw('ABCXYZ0123', 16)}"][i % 3]
        texts.append(f"{words(rng, 30)} {find if i % 4 == 0 else draw('0123456789', 16)} {words(rng, 30)}.")
    return secretscan.fit(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))


def test_held_out_kinds(field):
    """None of these forms is a pattern; five of eight are tagged whole after training on few finds."""
    rng = random.Random(5)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    made = [
        f"eyJ{draw(B62, 20)}.{draw(B62, 30)}.{draw(B62, 27)}", f"xoxb-{draw('0123456789', 12)}-{draw(B62, 24)}", f"glpat-{draw(B62, 20)}", f"SG.{draw(B62, 22)}.{draw(B62, 43)}",
        draw("0123456789abcdef", 20), f"MIIEvQ{draw(B62 + '+/', 58)}", f"npm_{draw(B62, 36)}", f"{draw('ABCDEFGHJK23456789', 8)}-{draw('ABCDEFGHJK23456789', 8)}-{draw('ABCDEFGHJK23456789', 8)}",
    ]
    scanner, found = secretscan.Scanner(field), 0
    for secret in made:
        text = f"{words(rng, 20)} {secret} {words(rng, 20)}"
        at = text.index(secret)
        found += scanner.scan([text])[0] == [("crf", at, at + len(secret))]
    assert found >= 5, found


def test_clean_texts_stay(field):
    rng = random.Random(6)
    clean = ["version 4.0.1 of 2024-05-06 costs 12,345.67 and +1 (242) 555-3475", "4162453409494942", "25.36.57.24", "see https://www.example.com/a/b?c=d", "ncr.81@mail6.example.com", "Äpfel und Übermut,", "a - b -- c", ""]
    texts = [f"{words(rng, 20)} {c} {words(rng, 20)}" for c in clean] + ["", " \n\t"]
    assert secretscan.Scanner(field).scan(texts) == [[]] * len(texts)


def test_stretches_equal_whole_viterbi():
    """Decoding only what can be a secret gives the labels of a whole text's best path."""
    rng = np.random.default_rng(1)
    letters = random.Random(2)
    texts = [" ".join("".join(letters.choice("ab0=. ") for _ in range(letters.randint(1, 4))) for _ in range(letters.randint(0, 40))) for _ in range(200)]

    def score(chain, emissions, tags, bounds):
        """Of each text, the sum over its path."""
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            t = tags[a:b]
            out.append(emissions[np.arange(a, b), t].sum() + (chain.first[t[0]] + chain.moves[t[:-1], t[1:]].sum() if b > a else 0))
        return np.array(out)

    tagged = 0
    for shift in (0.0, 0.1, 0.2, 0.3, 0.5):
        chain = crf.Chain(rng.normal(0, 1, (secretscan.SIZE, 3)) - [0, shift, shift], rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
        scanner = secretscan.Scanner(secretscan.Field(chain, {"a": 0, "=": 1}))
        codes, found = scanner.tags(texts)
        got = np.zeros(len(codes.token), np.int8)
        for _, places, tags in found:
            got[places] = tags
        emissions = scanner.emissions(codes)
        best = crf.viterbi(chain, emissions, np.diff(codes.bounds))
        assert np.allclose(score(chain, emissions, got, codes.bounds), score(chain, emissions, best, codes.bounds), rtol=0, atol=1e-9)
        tagged += (got > 0).sum()
        alone = [secretscan.Scanner(secretscan.Field(chain, {"a": 0, "=": 1})).scan([t])[0] for t in texts]
        assert alone == scanner.scan(texts)
    assert tagged > 1000


def test_weights_of_sequences_count():
    """A sequence of weight 3 trains like three sequences."""
    features, labels, lengths = np.array([[0], [1], [2], [1]]), np.array([0, 1, 1, 0]), np.array([2, 2])
    thrice = crf.train(np.concatenate([features, features[2:], features[2:]]), np.concatenate([labels, labels[2:], labels[2:]]), np.array([2, 2, 2, 2]), 3, 2)
    weighed = crf.train(features, labels, lengths, 3, 2, weights=np.array([1.0, 1, 3, 3]))
    assert np.allclose(thrice.weights, weighed.weights) and np.allclose(thrice.moves, weighed.moves) and np.allclose(thrice.first, weighed.first)
