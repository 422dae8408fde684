"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags every token of a text as begin, inside or outside of a secret, from the token's shape, its neighbours and features of the
whole text, and is decoded by Viterbi over the whole text. It learns from the patterns' finds and from perturbed copies of
them: other values in other surroundings, which no pattern describes.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .crf import Chain, train, viterbi
from .runtime import forget, unit

# Fixed patterns and least lengths of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
_LEAST = {"assign": 8, "access": 16, "hex": 32, "crf": 8}

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_MARK = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_PLAIN = re.compile(r"[\"'(«„“¿¡]*[^\W\d_]+(?:['’-][^\W\d_]+)*[^\w/+=@#$%&*]*", re.UNICODE)
_WORD = re.compile(r"\S+")
_TOKEN = re.compile(r"[\w+/~-]+(?:\.[\w+/~-]+)*|=+|[^\w+/~=-]+")
#: Features of a token: six of its own and four with its neighbours and its text.
_OWN, _FEATURES = 6, 10
SIZE = 1 << 18
#: Words and characters that a worker keeps: memory bounds, results do not depend on them.
_CACHE_WORDS, _CACHE_CHARS = 120_000, 12 << 20
#: Names of neighbours that the field tells apart, besides classes of tokens.
NAMES = 256
_OUT, _BEGIN, _INSIDE = 0, 1, 2
_CHARSETS = ("sign", "digits", "hex", "capitals", "letters", "upper", "camel", "mixed", "marked")
_LENGTHS = 13

Span = tuple[str, int, int]


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """``(kind, start, end, start of the secret itself)`` of the patterns' matches that are long enough."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    if b"x" * _LEAST["hex"] in text.encode("utf-8", "surrogatepass").translate(_HEX_MARK):
        out += [("hex", *m.span(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= _LEAST["hex"]]
    return out


def _slot(kind: str, value: object) -> int:
    return xxhash.xxh32_intdigest(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % SIZE


def _pair_slots(kind: int, *codes: np.ndarray) -> np.ndarray:
    """Slots of combined features, from their codes."""
    h = np.full(len(codes[0]), kind + 1, np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(SIZE)).astype(np.int64)


def _charset(token: str) -> str:
    if not any(map(str.isalnum, token)):
        return "sign"
    if token.isdigit():
        return "digits"
    if token.isalpha() or _PLAIN.fullmatch(token):
        core = "".join(filter(str.isalpha, token))
        return "letters" if core.islower() or core[1:].islower() or len(core) == 1 else "upper" if core.isupper() else "camel"
    if re.fullmatch(r"[0-9a-f]+", token):
        return "hex"
    if re.fullmatch(r"[A-Z0-9]+", token):
        return "capitals"
    return "mixed" if token.isalnum() else "marked"


def tokens_of(word: str) -> list[tuple[str, int]]:
    """Tokens of a word and their places in it; a plain word is one."""
    if len(word) < 32 and _PLAIN.fullmatch(word):
        return [(word, 0)]
    return [(m[0], m.start()) for m in _TOKEN.finditer(word)]


def _name(token: str) -> str:
    return token.lower().strip(".,;:!?\"'()[]") or token[:2]


@dataclass
class Field:
    """The trained chain, and the neighbours' names that it knows."""

    chain: Chain
    names: dict[str, int] = field(default_factory=dict)


class Texts(dict):
    """Codes of texts' tokens. Maps words to rows; words that are known are kept within a bound, and plain words share rows."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self._drop()

    def _drop(self) -> None:
        self.clear()
        self.chars = 0
        self.plain: dict[tuple[str, int, int], int] = {}
        self.first, self.count, self.odd = [], [], []
        self.own, self.shape, self.name, self.place, self.length = [], [], [], [], []

    def bounded(self) -> bool:
        """Drops what is kept if it is too much; whether it did."""
        if full := len(self) > _CACHE_WORDS or self.chars > _CACHE_CHARS:
            self._drop()
        return full

    def _token(self, charset: str, length: int, name: int, digits: int, entropy: int, start: str, place: int, size: int) -> None:
        self.own.append([_slot("set", charset), _slot("length", (charset, length)), _slot("digits", (digits, length)), _slot("entropy", (entropy, length)), _slot("start", start), _slot("bias", "")])
        self.shape.append(_CHARSETS.index(charset) * _LENGTHS + length)
        self.name.append(name)
        self.place.append(place)
        self.length.append(size)

    def __missing__(self, word: str) -> int:
        self.chars += len(word)
        if len(word) < 32 and _PLAIN.fullmatch(word):
            charset = "letters" if word.islower() or word[1:].islower() or len(word) < 3 else "upper" if word.isupper() else "camel"
            key = charset, len(word), self.names.get(_name(word), NAMES + _CHARSETS.index(charset))
            if (at := self.plain.get(key)) is None:
                at = self.plain[key] = len(self.first)
                self.first.append(len(self.shape))
                self.count.append(1)
                self.odd.append(False)
                self._token(charset, min(len(word) // 4, _LENGTHS - 1), key[2], 0, 0, charset, 0, len(word))
            self[word] = at
            return at
        at = self[word] = len(self.first)
        parts = [(m[0], m.start()) for m in _TOKEN.finditer(word)]
        self.first.append(len(self.shape))
        self.count.append(len(parts))
        self.odd.append(any(map(str.isdigit, word)) or len(word) >= 32)
        for token, place in parts:
            charset = _charset(token)
            share = {c: n / len(token) for c, n in Counter(token).items()}
            entropy = round(-sum(p * math.log2(p) for p in share.values()))
            digits = round(4 * sum(p for c, p in share.items() if c.isdigit()))
            name = self.names.get(_name(token), NAMES + _CHARSETS.index(charset))
            self._token(charset, min(len(token) // 4, _LENGTHS - 1), name, digits, entropy, token[:4] if charset in ("capitals", "marked", "mixed") else charset, place, len(token))
        return at

    def codes(self, texts: list[str]) -> Codes:
        lists = [t.split() for t in texts]
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        sizes = np.array([len(x) for x in lists], np.int64)
        count = np.array(self.count, np.int64)[ids] if len(ids) else np.zeros(0, np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        word = np.repeat(np.arange(len(ids)), count)
        token = np.repeat(np.array(self.first, np.int64)[ids] if len(ids) else ids, count) + np.arange(total) - np.repeat(ends - count, count)
        stops = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], ends])[stops]
        odd = np.diff(np.concatenate([[0], np.cumsum(np.array(self.odd, np.int64)[ids])])[stops]) if len(ids) else np.zeros(len(lists), np.int64)
        keyed = np.array([any(k in low for k in _KEYS) for low in map(str.lower, texts)], np.int64)
        return Codes(token, word - np.repeat(stops[:-1], np.diff(bounds)), bounds, 2 * np.minimum(odd, 3) + keyed)


@dataclass
class Codes:
    """Tokens of several texts, one after the other: rows of ``Texts``, words in their text, bounds of the texts and codes of whole texts."""

    token: np.ndarray
    word: np.ndarray
    bounds: np.ndarray
    file: np.ndarray

    def near(self, texts: Texts) -> list[np.ndarray]:
        """Slots of the features that a token has with its neighbours and its text."""
        shape, name = np.array(texts.shape, np.int64)[self.token], np.array(texts.name, np.int64)[self.token]
        edge = NAMES + len(_CHARSETS)

        def moved(by: int) -> np.ndarray:
            out = np.full(len(name), edge)
            if by > 0:
                out[by:] = name[:-by]
                for k in range(by):
                    at = self.bounds[:-1] + k
                    out[at[at < self.bounds[1:]]] = edge
            else:
                out[:-1] = name[1:]
                out[self.bounds[1:][self.bounds[1:] > self.bounds[:-1]] - 1] = edge
            return out

        before = moved(1)
        return [_pair_slots(0, before, shape), _pair_slots(1, moved(2), before, shape), _pair_slots(2, moved(-1), shape), _pair_slots(3, np.repeat(self.file, np.diff(self.bounds)), shape)]


_BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_DIGITS = "0123456789"
#: Surroundings and values of perturbed finds: what stands before, and alphabets with least and greatest length.
LEADS = ("", "", "key ", "auth ", "auth: ", "pwd ", "pwd=", "pass: ", "credential ", "credentials: ", "Bearer ", "private key ", "access key: ", "login ", "signature=", "use ")
VALUES = (("0123456789abcdef", 16, 40), (_BASE62, 12, 48), (_BASE62 + "_-", 16, 40), (_BASE62 + "+/", 20, 64), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 14, 32))
#: What is no secret, though it isn't plain: ``w`` stands for a few letters, ``n`` for a digit.
DECOYS = ("https://www.w.com/w/w-w?w=n", "http://w.org/w/nn/w.html", "www.w.net/w", "/usr/w/w/w.nn", "w.w@w.com", "nnnn-nn-nn", "nn.nn.nnnn", "nn:nn:nn", "n.n.nn", "nnn-nnnn", "(nnn)", "nnnnnnnnnnnnnnnn", "nnn.nn.nnn.n", "nn,nnn.nn", "w_w_w(w)", "w.w.w()", "W-nnnnn", "w-w-w", "#nnnnnn", "978-n-nn-nnnnnn-n", "wnn", "nnnnnnww")
#: Words on either side of a perturbed find.
REACH = 40


def perturbed(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """The words about the first find of ``text`` with another value in other surroundings and a decoy in its stead, and the secret's place."""
    start, end, _ = min(spans)
    before, after = text[:start].split(" ")[-REACH:], text[max(e for _, e, _ in spans) :].split(" ")[:REACH]
    alphabet, least, most = rng.choice(VALUES)
    prefix = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 5))) + rng.choice("_-.") if rng.random() < 0.5 else ""
    value = prefix + "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))
    letters = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    decoy = "".join(letters() if c == "w" else letters().upper() if c == "W" else rng.choice(_DIGITS) if c == "n" else c for c in rng.choice(DECOYS))
    middle = after.pop(rng.randrange(len(after))) if after else ""
    head = f"{' '.join(before)}{rng.choice(LEADS)}"
    cut = rng.randint(0, len(after))
    tail = f" {' '.join(after[:cut])} {decoy} {middle} {' '.join(after[cut:])}"
    return head + value + tail, [(len(head), len(head) + len(value))]


def _labels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Labels of the tokens: those that overlap a span are its beginning or inside."""
    out, inside = [], None
    for word in _WORD.finditer(text):
        for token, place in tokens_of(word[0]):
            at = word.start() + place
            hit = next((s for s in spans if at < s[1] and at + len(token) > s[0]), None)
            out.append(_OUT if hit is None else _INSIDE if hit == inside else _BEGIN)
            inside = hit
    return out


def _examples(clean_share: float, variants: int):
    """Texts with finds, perturbed copies of them and a share of the other texts, with the secrets' places and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                spans = [(s, e, v) for _, s, e, v in base_spans(text)]
                code = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
                if spans:
                    rows.append((text, [x for _, e, v in spans for x in (v, e)], 1.0))
                    for i in range(variants):
                        other, marks = perturbed(text, spans, random.Random(code + i))
                        rows.append((other, [x for m in marks for x in m], 1.0))
                elif code % (1 << 20) < clean_share * (1 << 20):
                    rows.append((text, [], 1 / clean_share))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.float64())], ["text", "marks", "weight"])

    return run


def silent() -> Field:
    """A field that never tags anything."""
    never = Chain(np.zeros((SIZE, 3)), np.zeros((3, 3)), np.array([0.0, -50.0, -50.0]))
    never.moves[:, 1:] = -50.0
    return Field(never)


def fit(docs: DataFrame, rows: int = 8_000, clean: int = 250, variants: int = 6, longest: int = 3_000, rounds: int = 20) -> Field:
    """Field from at most about ``rows`` distinct texts of ``docs``, drawn by a hash of the text, of at most ``longest`` characters.

    Of these, those with finds of the patterns come to the driver with ``variants`` perturbed copies each, and about ``clean`` of the
    others, which weigh for all of them. Tokens of the finds and of the values put in their place are secrets, all
    others are outside. Without any find nothing is ever tagged.
    """
    total = max(1, docs.count())
    text = F.col("text").cast("string")
    drawn = docs.where((F.length(text) <= longest) & (unit(text, F.lit("secret")) < rows / total)).select(text.alias("text")).distinct()
    share = min(1.0, clean / min(rows, total))
    got = drawn.mapInArrow(_examples(share, variants), "text string, marks array<bigint>, weight double").toArrow().to_pylist()
    return fit_examples([(r["text"], list(zip(r["marks"][::2], r["marks"][1::2], strict=True)), r["weight"]) for r in got], rounds)


def fit_examples(examples: list[tuple[str, list[tuple[int, int]], float]], rounds: int = 30) -> Field:
    """Field from texts with the places of their secrets and their weights."""
    if not any(spans for _, spans, _ in examples):
        return silent()
    examples = sorted(examples)  # the same sums in whatever order they come
    labels = [_labels(t, s) for t, s, _ in examples]
    # Neighbours' names: what stands up to two tokens before or one after a secret at least twice.
    seen: Counter[str] = Counter()
    for (text, _, _), tags in zip(examples, labels, strict=True):
        if any(tags):
            names = [_name(t) for w in text.split() for t, _ in tokens_of(w)]
            for i in np.flatnonzero(tags).tolist():
                seen.update(names[j] for j in (i - 2, i - 1, i + 1) if 0 <= j < len(names) and not tags[j])
    names = {n: i for i, (n, c) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:NAMES]) if c > 1}
    texts = Texts(names)
    codes = texts.codes([t for t, _, _ in examples])
    features = np.concatenate([np.array(texts.own, np.int64)[codes.token], *[x[:, None] for x in codes.near(texts)]], 1)
    flat = np.array([x for tags in labels for x in tags], np.int64)
    lengths = np.diff(codes.bounds)
    weights = np.repeat(np.array([w for _, _, w in examples]), lengths)
    return Field(train(features, flat, lengths, SIZE, 3, rounds=rounds, weights=weights), names)


def possible(model: Chain, emissions: np.ndarray) -> np.ndarray:
    """Tokens of a text that a best path may tag as secret; all others are outside on every best path.

    A token in a secret gains at most what its labels and the best moves to them and from them to the outside give over
    staying outside. A stretch of which the gains sum up to nothing is better left outside, so only tokens of a stretch with a positive sum
    need decoding.
    """
    moves, stay = model.moves, model.moves[_OUT, _OUT]
    into = np.maximum(moves.max(0), model.first)[1:] - min(stay, model.first[_OUT])
    back = max(0.0, float((moves[1:, _OUT] - stay).max()))
    gain = (emissions[:, 1:] - emissions[:, :1] + into).max(1) + back
    if not (gain > 0).any():
        return np.zeros(0, np.int64)
    before = np.cumsum(gain)
    ending = before - np.minimum.accumulate(np.concatenate([[0.0], before[:-1]]))
    after = np.cumsum(gain[::-1])
    starting = (after - np.minimum.accumulate(np.concatenate([[0.0], after[:-1]])))[::-1]
    return np.flatnonzero(ending + starting - gain > -1e-9)


class Scanner:
    def __init__(self, model: Field):
        self.chain, self.texts = model.chain, Texts(model.names)
        self.scores = np.zeros((0, 3))

    def emissions(self, codes: Codes) -> np.ndarray:
        t, w = self.texts, self.chain.weights
        if len(t.own) > len(self.scores):
            new = w[np.array(t.own[len(self.scores) :], np.int64)].sum(1)
            self.scores = np.concatenate([self.scores, new])
        out = self.scores[codes.token]
        for slots in codes.near(t):
            out = out + w[slots]
        return out

    def tags(self, texts: list[str]) -> tuple[Codes, list[tuple[int, list[int], np.ndarray]]]:
        """Codes of the texts, and for each stretch to be decoded: text, places of its tokens, and their labels on the best path of the whole text."""
        if self.texts.bounded():
            self.scores = self.scores[:0]
        codes = self.texts.codes(texts)
        if not len(codes.token):
            return codes, []
        all_ = self.emissions(codes)
        stretches, parts = [], []
        for i in range(len(texts)):
            a, b = int(codes.bounds[i]), int(codes.bounds[i + 1])
            at = possible(self.chain, all_[a:b]) if b > a else np.zeros(0, np.int64)
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else []:
                # The neighbours on either side are outside; at an end of the text there is none.
                first, last = max(0, int(run[0]) - 1), min(b - a, int(run[-1]) + 2)
                part = all_[a + first : a + last].copy()
                if first == run[0] - 1:
                    part[0, 1:] = -1e9
                    if first > 0:
                        part[0] -= self.chain.first
                if last == run[-1] + 2:
                    part[-1, 1:] = -1e9
                stretches.append((i, a + first, last - first))
                parts.append(part)
        if not parts:
            return codes, []
        lengths = np.array([n for _, _, n in stretches], np.int64)
        labels = np.split(viterbi(self.chain, np.concatenate(parts), lengths), np.cumsum(lengths)[:-1])
        return codes, [(i, list(range(at, at + n)), tags) for (i, at, n), tags in zip(stretches, labels, strict=True)]

    def scan(self, batch: list[str]) -> list[list[Span]]:
        """All spans of each text, by start and then kind; spans of the field don't overlap those of patterns."""
        base = [base_spans(t) for t in batch]
        out: list[list[Span]] = [[(k, s, e) for k, s, e, _ in spans] for spans in base]
        codes, found = self.tags(batch)
        starts: dict[int, list[int]] = {}
        for i, places, tags in found:
            if not tags.any():
                continue
            if i not in starts:
                starts[i] = [m.start() for m in _WORD.finditer(batch[i])]
            begin = end = None
            for at, tag in zip([*places, None], [*tags.tolist(), _OUT], strict=True):
                if tag != _INSIDE and begin is not None:
                    if end - begin >= _LEAST["crf"] and not any(begin < e and end > s for _, s, e, _ in base[i]):
                        out[i].append(("crf", begin, end))
                    begin = None
                if tag != _OUT:
                    token = int(codes.token[at])
                    place = starts[i][int(codes.word[at])] + self.texts.place[token]
                    begin = place if begin is None else begin
                    end = place + self.texts.length[token]
        return [sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])) for spans in out]


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < most):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch with their texts, so that a worker holds few texts as Python strings at once."""
    column = batch.schema.get_field_index("text")
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).to_pylist()


def scan(docs: DataFrame, model: Field) -> DataFrame:
    """``(doc_id, spans)``, one row for each row of ``docs``; ``spans`` are structs of kind, start and end in code points.

    Null texts count as empty and have no spans. Null ids and repeated rows are scanned like others. An empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scanner = Scanner(shared.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part, own in _parts(batch):
                texts = [t or "" for t in own]
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for a, b in _slices(texts) for found in scanner.scan(texts[a:b])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, model: Field, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by ``mark``; overlapping spans are replaced together.

    Other columns stay, but ``n_chars``, if there, counts the new text's code points where the text has changed. Null texts stay null,
    null ids and repeated rows are treated like others, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def clean(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for _, start, end in spans:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scanner = Scanner(shared.value)
        for batch in batches:
            for part, texts in _parts(batch):
                filled = [t or "" for t in texts]
                spans = [found for a, b in _slices(filled) for found in scanner.scan(filled[a:b])]
                new = [clean(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | {"text": pa.array(new, pa.string())}
                if "n_chars" in names:
                    old = part.column(part.schema.get_field_index("n_chars")).to_pylist()
                    columns["n_chars"] = pa.array([len(n) if s else o for n, s, o in zip(new, spans, old, strict=True)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans, each as ``kind:start:end`` joined by commas; last, the number of the field's own."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("crf"))
