"""Language identification by prediction by partial matching.

Each language has a context tree over bytes of order 3, 2, 1 and 0. Training counts are frozen; the code length of a
byte follows by method C with exclusion: a context gives a seen byte ``count / (total + distinct)`` and escapes with
``distinct / (total + distinct)`` to the next shorter context, which leaves out what was refused. Below order 0 all bytes that are left
are equally likely. A text belongs to the language that codes its bytes shortest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .runtime import forget, unit

ORDER = 3
#: Bytes of the stretch whose likelihood is a prediction's score; that of a whole text would nearly always be 0 or 1.
STRETCH = 32
#: Columns that a prediction adds.
ADDED = ("lang_pred", "score", "bits")
#: Bytes that are coded at once, bytes of the texts that are joined for it, rows taken from a batch at a time and entries from which a language's counts are merged:
#: memory bounds of a worker, which shares its executor with what other stages have left there.
_SLICE, _JOINED, _ROWS, _ENTRIES = 1 << 16, 1 << 18, 512, 200_000
_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    """Frozen code lengths in bits: ``bits[row[context] * symbols + symbol, language]``.

    ``symbol`` maps bytes to symbols, the last one for bytes that training didn't have; ``row`` maps
    the code of three preceding symbols to that of the longest context known.
    """

    languages: list[str]
    symbol: np.ndarray
    row: np.ndarray
    bits: np.ndarray

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 1


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(_LETTER.search(text) or any(map(str.isalpha, text.decode("utf-8", "ignore"))))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that a worker holds few texts and their arrays at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of each run of four bytes by language; a text begins after three zero bytes."""
    sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    most: dict[str, int] = {}

    def merged(parts):
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    forget()
    for batch in _parts(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            whole = np.frombuffer(b"\0\0\0" + text, np.uint8)
            for i in range(0, len(text), _SLICE):
                x = whole[i : i + _SLICE + ORDER].astype(np.uint32)
                runs = x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]
                parts = sums.setdefault(lang, [])
                parts.append(np.unique(runs, return_counts=True))
                if sum(len(k) for k, _ in parts) > most.get(lang, _ENTRIES):
                    sums[lang] = [merged(parts)]
                    most[lang] = max(_ENTRIES, 2 * len(sums[lang][0][0]))
    for lang, parts in sums.items():
        keys, n = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "run", "n"])


def code_lengths(counts: list[np.ndarray], contexts: np.ndarray, symbols: int) -> np.ndarray:
    """Bits of every symbol (and, last, of any that counts don't have) in each context.

    ``counts[k]`` has the counts of order k, by code of the context and symbol; ``contexts`` holds one code per order,
    -1 where a context is shorter than that order.
    """
    m = len(contexts)
    out, escape, seen = np.zeros((m, symbols)), np.ones((m, 1)), np.zeros((m, symbols), bool)
    for order in range(len(counts) - 1, -1, -1):
        at = contexts[:, order]
        c = np.where((at >= 0)[:, None] & ~seen, counts[order][at], 0)
        n, q = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        out += np.where(c > 0, escape * c / np.maximum(n + q, 1), 0)
        escape = escape * np.where(n > 0, q / np.maximum(n + q, 1), 1)
        seen |= c > 0
    left = 256 - seen.sum(1, keepdims=True)
    return -np.log2(np.where(seen, out, escape / np.maximum(left, 1)))


def fit(docs: DataFrame, rows_per_language: int = 3000, least: int = 32, language: str = "lang") -> Model:
    """Model from ``docs`` with ``doc_id``, ``text`` and a language column; null texts and languages are left out.

    Counts are taken, in Spark, over at most about ``rows_per_language`` distinct texts of each language, drawn by a hash of the text: only these bounded
    counts come to the driver. Contexts of order 3 and 2 that occur fewer than ``least`` times in all are cut off.
    """
    known = docs.select(F.col("text").cast("string").alias("text"), F.col(language).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(256, np.int64), np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    share: Column = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, F.lit(rows_per_language / sizes[name])).otherwise(share)
    drawn = known.where(unit("text", F.lit("language")) < share).distinct()
    grams = drawn.select("lang", "text").mapInArrow(_count, "lang string, run bigint, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n"))
    got = grams.toArrow()
    lang = pc.index_in(got.column("lang"), value_set=pa.array(languages)).to_numpy()
    run, n = got.column("run").to_numpy().astype(np.uint32), got.column("n").to_numpy()
    del got
    bytes_ = np.stack([(run >> s & 255).astype(np.uint8) for s in (24, 16, 8, 0)])
    used = np.unique(bytes_[3])
    size = len(used) + 1
    symbol = np.full(256, size - 1, np.int64)
    symbol[used] = np.arange(len(used))
    s = symbol.astype(np.int32)[bytes_]
    # The zero bytes before a text take the code of the symbol for unknown bytes.
    code2, code3 = s[1] * size + s[2], (s[0] * size + s[1]) * size + s[2]
    rows = [np.array([[0, -1, -1, -1]])]
    maps = []
    for code in (s[2], code2, code3):
        found, at = np.unique(code, return_inverse=True)
        maps.append(found[np.bincount(at, weights=n) >= (1 if code is s[2] else least)].astype(np.int64))
    # Cells of the order's codes, four bytes each: the largest of what the fit holds, and nothing of that size stands beside them.
    index = {k: np.full(size**k, -1, np.int32) for k in (1, 2, 3)}
    for k in (1, 2, 3):
        index[k][maps[k - 1]] = np.arange(len(maps[k - 1]))
    ones = np.stack([np.zeros(len(maps[0]), np.int64), np.arange(len(maps[0])), *[np.full(len(maps[0]), -1)] * 2], 1)
    twos = np.stack([np.zeros(len(maps[1]), np.int64), index[1][maps[1] % size], np.arange(len(maps[1])), np.full(len(maps[1]), -1)], 1)
    threes = np.stack([np.zeros(len(maps[2]), np.int64), index[1][maps[2] % size], index[2][maps[2] % size**2], np.arange(len(maps[2]))], 1)
    contexts = np.concatenate([*rows, ones, twos, threes])
    bits = np.empty((len(contexts), size, len(languages)), np.float32)
    for at in range(len(languages)):
        own = lang == at
        counts = []
        for k, code in enumerate((np.zeros(len(run), np.int64), s[2], code2, code3)):
            where = code if k == 0 else index[k][code]
            table = np.zeros((1 if k == 0 else len(maps[k - 1]), size), np.float32)
            keep = own & (where >= 0)
            np.add.at(table, (where[keep], s[3][keep]), n[keep])
            counts.append(table if len(table) else np.zeros((1, size), np.float32))
        for i in range(0, len(contexts), 4096):
            bits[i : i + 4096, :, at] = code_lengths(counts, contexts[i : i + 4096], size)
    starts = np.cumsum([0, 1, len(ones), len(twos)])
    one = np.where(index[1] >= 0, starts[1] + index[1], 0)
    two = np.where(index[2] >= 0, starts[2] + index[2], np.tile(one, size)).astype(np.int32)
    row = index.pop(3).reshape(size, -1)
    for own in row:  # in place
        own[:] = np.where(own >= 0, starts[3] + own, two)
    return Model(languages, symbol, row.ravel(), bits.reshape(-1, len(languages)))


def score_bits(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length of each whole text in each language."""
    size, n = model.symbols, len(texts)
    out = np.zeros((n, len(model.languages)))
    pad = bytes(ORDER)
    stream = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    owner = np.repeat(np.tile([n, 0], n) if n else np.empty(0, np.int64), np.array([x for t in texts for x in (ORDER, len(t))], np.int64))
    owner[owner != n] = np.repeat(np.arange(n), [len(t) for t in texts])
    for i in range(ORDER, len(stream), _SLICE):
        part = model.symbol[stream[i - ORDER : i + _SLICE]]
        row = model.row[(part[:-3] * size + part[1:-2]) * size + part[2:-1]]
        cost = model.bits[row * np.int64(size) + part[3:]]
        own = owner[i : i + _SLICE]
        first, last = int(own[own < n].min(initial=n)), int(own[own < n].max(initial=-1))
        if last >= 0:
            own = np.where(own == n, last + 1, own) - first
            for k in range(out.shape[1]):
                out[first : last + 1, k] += np.bincount(own, weights=cost[:, k], minlength=last - first + 2)[: last - first + 1]
    return out


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        for batch in _parts(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            names, scores, lengths = [], [], []
            some = [i for i, t in enumerate(texts) if model.languages and has_letter(t)]
            at = 0
            got = np.zeros((len(some), len(model.languages)))
            while at < len(some):
                upto, size = at, 0
                while upto < len(some) and (upto == at or size + len(texts[some[upto]]) < _JOINED):
                    size += len(texts[some[upto]])
                    upto += 1
                got[at:upto] = score_bits(model, [texts[i] for i in some[at:upto]])
                at = upto
            place = dict(zip(some, range(len(some)), strict=True))
            for i in range(len(texts)):
                if i not in place:
                    names.append("und"), scores.append(0.0), lengths.append(None)
                    continue
                bits = got[place[i]]
                best = int(bits.argmin())
                names.append(model.languages[best])
                size = len(texts[i])
                scores.append(float(1 / np.exp2((bits[best] - bits) * (min(size, STRETCH) / size)).sum()))
                lengths.append(float(bits[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64())], [*batch.schema.names, *ADDED])

    return run


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits``, predicted from ``text`` alone.

    ``lang_pred`` is the language with the shortest code for the whole text (of equals the first by name), ``score`` its share of the
    likelihood of all languages for an average stretch of ``STRETCH`` bytes, ``bits`` that code's length. A text that is null or has no letter gets ``und``, score 0 and null
    bits, as all do if the model has no language. Null ids and repeated rows are scored like others. An empty table gives
    an empty result. Columns of these names that are there already are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*ADDED).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())])
    return rows.mapInArrow(_predict(shared), schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, bits)``, one row for each row of ``docs``; see ``tag``."""
    return tag(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model).drop("text")
