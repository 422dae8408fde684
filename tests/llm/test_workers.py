"""What a Python worker holds and keeps: stages of a pipeline share the workers of an executor."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from affinis.llm import langid, pieces
from affinis.llm.queries import piece_model


def peak_mb(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(n):
    rng = np.random.default_rng(0)
    words = np.array(["".join(w) for w in rng.choice(list("abcdefgh äéß"), (3000, 6))])
    return [" ".join(rng.choice(words, 500)) for _ in range(n)]


@pytest.fixture(scope="module")
def batch():
    rows = texts(4000)
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "lang": ["en", "fr"] * (len(rows) // 2), "text": rows})


@pytest.fixture(scope="module")
def model():
    """Two languages of one row for all contexts."""
    bits = np.random.default_rng(1).random((257, 2)).astype(np.float32)
    return langid.Model(["en", "fr"], np.arange(256), np.zeros(256**3, np.int32), bits)


def test_language_worker_holds_a_part_of_a_batch(batch, model):
    """A batch of 14 MB of text is tagged in parts: neither its texts nor their arrays are held at once."""
    done = []

    def run():
        for part in langid._predict(SimpleNamespace(value=model))(iter([batch])):
            done.append((part.num_rows, part.column("bits").to_pylist()))

    _, mb = peak_mb(run)
    assert mb < 14
    assert sum(n for n, _ in done) == batch.num_rows
    symbols = [np.frombuffer(t.encode(), np.uint8) for t in batch.column("text").to_pylist()]
    want = [min(model.bits[s].astype(float).sum(0)) for s in symbols]
    assert np.allclose([x for _, part in done for x in part], want)


def test_language_counts_hold_a_part_of_a_batch(batch):
    """Counts of parts are merged before they outgrow the result by far."""
    parts, mb = peak_mb(lambda: list(langid._count(iter([batch]))))
    assert mb < 30
    got = {p.column("lang")[0].as_py(): sum(p.column("n").to_pylist()) for p in parts}
    sizes = [len(t.encode()) for t in batch.column("text").to_pylist()]
    assert got == {"en": sum(sizes[::2]), "fr": sum(sizes[1::2])}


def test_workers_keep_one_operators_things(batch, model):
    """What SentencePiece keeps for its next task goes as soon as another operator's task comes."""
    made = pieces.encoder(piece_model())
    assert pieces.encoder(piece_model()) is made
    list(langid._predict(SimpleNamespace(value=model))(iter([batch.slice(0, 10)])))
    assert pieces.encoder(piece_model()) is not made
