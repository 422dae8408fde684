"""Toxic spans and document scores by a linear-chain conditional random field.

Tokens get their labels from labelled documents: a token of a toxic document is toxic if its word or beginning takes a far
greater share of the words of toxic documents than of clean ones, where it may stand by chance. The field is trained on these sentences. Forward-backward marginals of all
tokens of a text are summed up to a calibrated document score, and the likely tokens are its spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .crf import Chain, marginals, train
from .words import WordHashes, mix, shingles

#: Size of the hashed feature space; each kind of feature has a slot of its own kind in the hash.
SIZE = 1 << 19
#: Logarithm of the ratio of those shares from which a word or beginning is evidence.
LEAST_RATIO = 3.0
#: Added to the words of a text, so that shares in very short texts don't decide.
SHORT = 50
#: About the share of one occurrence in a text of 500 words, added to both sums of shares.
RARE = 0.002
_CACHE = 300_000
_SHARED = 100_000
_TOKEN = re.compile(r"\S+")
_EDGE = ".,!?;:\"'()[]{}«»“”„*_-"
_BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    chain: Chain
    slope: np.ndarray
    bias: float


def _slot(kind: str, value: str) -> int:
    return xxhash.xxh32_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % SIZE


#: For what many words share: beginnings, lengths and shapes.
_common = lru_cache(1 << 16)(_slot)


def _core(token: str) -> str:
    return token.strip(_EDGE) or token


def evidence(token: str) -> list[str]:
    """What a token shows of its own: its word and its beginnings."""
    word = _core(token)
    return [f"w:{word}", *[f"{n}:{word[:n]}" for n in _BEGINNINGS if len(word) > n - 1]]


def _own(token: str) -> list[int]:
    word = _core(token)
    shape = ("d" if any(map(str.isdigit, word)) else "") + ("a" if word.isascii() else "u") + str(min(len(word), 12))
    whole, *beginnings = evidence(token)
    found = [_slot("e", whole), *[_common("e", b) for b in beginnings]]
    return [*found, *[_common("short", str(len(word)))] * (1 + len(_BEGINNINGS) - len(found)), _common("shape", shape), _common("bias", "")]


def _near(token: str) -> tuple[int, int]:
    word = _core(token)
    return _slot("before", word), _slot("after", word)


def sentences(tokens: list[str]) -> list[int]:
    """Lengths of the runs that end with a full stop, exclamation or question mark."""
    ends = [i + 1 for i, t in enumerate(tokens) if t[-1] in ".!?"]
    if not ends or ends[-1] != len(tokens):
        ends.append(len(tokens))
    return [b - a for a, b in zip([0, *ends], ends) if b > a]


def _features(tokens: list[str], lengths: list[int]) -> np.ndarray:
    none = _slot("edge", "")
    out, at = [], 0
    for n in lengths:
        near = [_near(t) for t in tokens[at : at + n]]
        for i in range(n):
            out.append([*_own(tokens[at + i]), near[i - 1][0] if i else none, near[i + 1][1] if i + 1 < n else none])
        at += n
    return np.array(out, np.int64).reshape(-1, 5 + len(_BEGINNINGS))


def _summary(m: np.ndarray, words: int) -> np.ndarray:
    """What the score sees of a text's marginals: the highest, their sum, and the sum in proportion to the length, as it is and as a logarithm."""
    total = m.sum()
    return np.array([m.max(initial=0.0), math.log1p(total), 10 * total / (words + 10), math.log((total + 0.1) / (words + 20))])


class Tagger:
    """Marginals of whole texts; contributions of words met before, and of what many words share, are kept, within a bound."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.words: dict[str, int] = {}
        self.table = np.zeros((1024, 3 * chain.labels + 1))
        self.shared: dict[tuple[str, int, bool, bool], int] = {}
        self.sums: list[float] = []
        self.edge = chain.weights[_slot("edge", "")]

    def _shared(self, word: str) -> int:
        """Place of the sum of a word's own slots but that of the whole word: its beginnings, shape and the constant tell all of them."""
        key = word[: max(_BEGINNINGS)], min(len(word), 12), word.isascii(), not word.isalpha() and any(map(str.isdigit, word))
        if (at := self.shared.get(key)) is None:
            at = self.shared[key] = len(self.shared)
            self.sums += self.chain.weights[_own(word)[1:]].sum(0).tolist()
        return at

    def _learn(self, tokens: list[str]) -> None:
        first = len(self.words)
        self.words.update(zip(tokens, range(first, first + len(tokens)), strict=True))
        while len(self.words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        w, n = self.chain.weights, len(tokens)
        if len(self.shared) > _SHARED:
            self.shared.clear()
            self.sums.clear()
        words = [t.strip(_EDGE) or t for t in tokens]
        coded = [x.encode("utf-8", "surrogatepass") for x in words]
        digest = xxhash.xxh32_intdigest
        whole, before, after = (w[np.fromiter((digest(kind + x) for x in coded), np.int64, n) % SIZE] for kind in (b"e:w:", b"before:", b"after:"))
        rest = np.fromiter(map(self._shared, words), np.int64, n)
        ends = np.fromiter((t[-1] in ".!?" for t in tokens), float, n)[:, None]
        self.table[first : first + n] = np.concatenate([whole + np.array(self.sums).reshape(-1, self.chain.labels)[rest], before, after, ends], 1)

    def toxic(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the probability of each token to be toxic."""
        if len(self.words) > _CACHE:
            self.words.clear()
        k = self.chain.labels
        lists = [t.lower().split() for t in texts]
        sizes = [len(x) for x in lists]
        tokens = [t for x in lists for t in x]
        if new := list(set(tokens) - self.words.keys()):
            self._learn(new)
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens))
        if not len(ids):
            return [np.zeros(0) for _ in lists]
        rows = self.table[ids]
        ends = rows[:, -1] > 0
        ends[np.cumsum([n for n in sizes if n]) - 1] = True
        stops = np.flatnonzero(ends) + 1
        lengths = np.diff(stops, prepend=0)
        emissions = rows[:, :k].copy()
        first = np.concatenate([[True], ends[:-1]])
        emissions[1:] += rows[:-1, k : 2 * k] * ~first[1:, None]
        emissions[first] += self.edge
        emissions[:-1] += rows[1:, 2 * k : 3 * k] * ~ends[:-1, None]
        emissions[ends] += self.edge
        return np.split(marginals(self.chain, emissions, lengths)[:, 1], np.cumsum(sizes)[:-1])


def distinct_texts(texts: list[list[str]], hashes: int = 8) -> list[int]:
    """Indices of texts of which no earlier one is a copy or near copy: of ``hashes`` minhashes under half agree with any."""
    words, seen, kept = WordHashes(), {}, []
    salt = np.random.default_rng(0).integers(0, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    for i, tokens in enumerate(texts):
        sets = shingles(words.of([t.encode("utf-8", "surrogatepass") for t in tokens]), 3)
        if not len(sets):
            continue
        mins = mix(sets[:, None] * salt).min(0).tolist()
        votes = Counter(seen[x] for x in enumerate(mins) if x in seen)
        if max(votes.values(), default=0) < hashes // 2:
            kept.append(i)
            seen.update((x, i) for x in enumerate(mins))
    return kept


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = 1500, longest: int = 20_000, seed: int = 3, clean_tokens: int = 30_000) -> Model:
    """Model from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``toxic``).

    Trained on a bounded sample: about ``rows_per_label`` rows of either label, drawn by a hash of the id, of at most
    ``longest`` characters. Of the sentences without toxic tokens about ``clean_tokens`` tokens train the field, and weigh for all of them. Null texts, ids and labels are left out; an id that is labelled more than once counts once, as toxic if any
    label says so, and of rows that repeat an id all texts count. Without rows of both labels all scores are 0.
    """
    from pyspark.sql.functions import broadcast

    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    none = Model(Chain(np.zeros((SIZE, 2)), np.zeros((2, 2)), np.array([0.0, -20.0])), np.zeros(4), -20.0)
    if len(sizes) < 2:
        return none
    share = F.when(F.col("toxic") == 1, F.lit(rows_per_label / sizes[1])).otherwise(F.lit(rows_per_label / sizes[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).limit(4 * rows_per_label).toPandas()
    chosen = docs.sparkSession.createDataFrame(drawn, "doc_id bigint, toxic int")  # at most 4 * rows_per_label ids
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") <= longest).join(broadcast(chosen), "doc_id").distinct().orderBy("doc_id", "text").limit(8 * rows_per_label).select("text", "toxic").toPandas()
    texts, toxic = [t.lower().split() for t in sample["text"]], sample["toxic"].to_numpy()
    # Copies would make any word of theirs look like evidence.
    own = distinct_texts(texts)
    texts, toxic = [texts[i] for i in own], toxic[own]
    if len(set(toxic.tolist())) < 2:
        return none
    n = [int((toxic == y).sum()) for y in (0, 1)]
    seen: Counter[str] = Counter()
    shares = [defaultdict(float), defaultdict(float)]
    for tokens, y in zip(texts, toxic, strict=True):
        own_counts = Counter(e for t, c in Counter(tokens).items() for e in evidence(t) * c)
        for e, c in own_counts.items():
            shares[y][e] += c / (len(tokens) + SHORT)
        if y:
            seen.update(own_counts.keys())
    least = max(2, min(15, n[1] // 10))
    signs = {e for e, c in seen.items() if c >= least and math.log((shares[1][e] + RARE) / n[1]) - math.log((shares[0].get(e, 0.0) + RARE) / n[0]) >= LEAST_RATIO}
    rng = np.random.default_rng(seed)
    tokens, tags, lengths, weights = [], [], [], []
    share_clean = min(1.0, clean_tokens / max(1, sum(map(len, texts))))
    for words, y in zip(texts, toxic, strict=True):
        at = 0
        for size in sentences(words):
            part = words[at : at + size]
            at += size
            marks = [int(bool(y) and any(e in signs for e in evidence(t))) for t in part]
            if any(marks) or rng.random() < share_clean:
                tokens += part
                tags += marks
                lengths.append(size)
                weights += [1.0 if any(marks) else 1 / share_clean] * size
    chain = train(_features(tokens, lengths), np.array(tags, np.int64), np.array(lengths, np.int64), SIZE, 2, weights=np.array(weights))
    tagger = Tagger(chain)
    found = [m for i in range(0, len(texts), 256) for m in tagger.toxic([" ".join(t) for t in texts[i : i + 256]])]
    x = np.array([_summary(m, len(m)) for m in found])
    # Logistic regression by Newton steps; labels weigh as among all labelled rows.
    share_1 = sizes[1] / (sizes[0] + sizes[1])
    x1, weight = np.concatenate([x, np.ones((len(x), 1))], 1), np.where(toxic == 1, share_1 / n[1], (1 - share_1) / n[0])
    beta = np.zeros(x1.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        slope = x1.T @ (weight * (p - toxic)) + 1e-4 * beta
        beta -= np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 1e-4 * np.eye(x1.shape[1]), slope)
    return Model(chain, beta[:-1], float(beta[-1]))


def _scored(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tagger = Tagger(model.chain)
        for whole in batches:
            at = 0
            texts = whole.column("text").to_pylist()
            scores, spans = [], []
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") < 2 << 20):
                    size += len(texts[upto] or "")
                    upto += 1
                part = [t or "" for t in texts[at:upto]]
                for text, m in zip(part, tagger.toxic(part), strict=True):
                    scores.append(float(1 / (1 + np.exp(-np.clip(_summary(m, len(m)) @ model.slope + model.bias, -30, 30)))))
                    hot = np.flatnonzero(m >= least).tolist()
                    if hot:
                        places = [x.span() for x in _TOKEN.finditer(text)]
                        spans.append([{"start": places[i][0], "end": places[i][1], "probability": float(m[i])} for i in hot])
                    else:
                        spans.append([])
                at = upto
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([whole.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``(doc_id, score, spans)``, one row for each row of ``docs``, from ``text`` alone.

    ``score`` is from 0 to 1. ``spans`` are the tokens whose marginal is at least ``least``, with their places in code points
    and that probability. Null and empty texts are scored as texts without tokens. Null ids and repeated
    rows are scored like others. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(shared, least), "doc_id bigint, score double, spans array<struct<start:bigint,end:bigint,probability:double>>")
