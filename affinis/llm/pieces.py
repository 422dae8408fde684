"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is a lattice of vocabulary pieces and its encoding the best path: for unigram models the one with the highest
sum of scores, for BPE models the only one of which all neighbouring pieces stand together (a pair that byte-pair
merging would not give has weight minus infinity). Giant texts are split into chunks. A chunk yields a
transfer matrix in the max-plus semiring between the states at its two ends, a state being the piece that lies across
the cut. Products of these matrices, which are associative, give the state at each cut, and every chunk is then backtraced
on its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .runtime import kept

SPACE = "▁"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
#: Words and their beginnings, and pairs of pieces, that a worker keeps: a memory bound. Longer words (in characters) aren't kept.
_CACHE, _PAIRS, _SHORT = 160_000, 200_000, 64
#: Characters from which a text is split, characters of a chunk, and chunks whose matrices one task multiplies.
GIANT, CHUNK, BLOCK = 1 << 16, 1 << 14, 256
_START = (0, -1)

State = tuple[int, int]
Matrix = dict[State, dict[State, float]]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """Vocabulary of a SentencePiece model file (BPE or unigram, without a character map)."""

    def __init__(self, model: bytes):
        self.surface: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown, self.prefix, self.squeeze, unigram = 0, True, True, True
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                text, kind = part[1].decode(), part.get(3, _NORMAL)
                at = len(self.surface)
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.surface.append(text.encode() if kind in (_NORMAL, _USER) else b"")
                if kind in (_NORMAL, _USER):
                    self.ids[text] = at
                elif kind == _BYTE:
                    self.byte_ids[int(text[3:-1], 16)] = at
                    self.surface[at] = bytes([int(text[3:-1], 16)])
                elif kind == _UNKNOWN:
                    self.unknown, self.surface[at] = at, " ⁇ ".encode()
            elif number == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not supported")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.squeeze:
            raise ValueError("models that remove extra white space are not supported")
        self.unigram = unigram
        self.longest = max(map(len, self.ids), default=1)
        self.low = min(self.scores, default=0.0) - 10
        # By left * stride + right: the stride is odd, so that keys differ in the low bits by which a dict deals them.
        self._pairs: dict[int, bool] = {}
        self.stride = len(self.surface) | 1
        self._whole: dict[int, bool] = {}
        # The two halves of whose merging a piece comes, and whether every half in it is made before the whole.
        self._halves: dict[str, tuple[str, str]] = {}
        self._ordered: dict[str, bool] = {}
        # Without pieces that have a space after something else, every word is encoded by itself.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._texts = {i: t for t, i in self.ids.items()}

    @cached_property
    def inner(self) -> set[str]:
        """Two characters of which no piece has one after the other always have a piece's end between them."""
        return {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}

    @cached_property
    def trie(self) -> dict:
        """Pieces that stand, letter by letter; the id of one that ends is kept under the empty string."""
        root: dict = {}
        for piece, at in self.ids.items():
            if self.stands(at):
                node = root
                for letter in piece:
                    node = node.setdefault(letter, {})
                node[""] = at
        return root

    @cached_property
    def ends(self) -> dict:
        """Pieces that stand, letter by letter from their last; under the empty string the id of one that is whole, its bytes and size."""
        root: dict = {}
        for piece, at in self.ids.items():
            if self.stands(at):
                node = root
                for letter in reversed(piece):
                    node = node.setdefault(letter, {})
                node[""] = at, at.to_bytes(4, "little"), len(piece)
        return root

    @cached_property
    def letters(self) -> set[str]:
        return {p for p in self.ids if len(p) == 1}

    def merge(self, text: str, least: int = 1) -> list[str]:
        """Byte-pair merging down to ``least`` parts: the pair of the highest score first, of equal scores the leftmost."""
        parts = list(text)
        while len(parts) > least:
            best = None
            for i in range(len(parts) - 1):
                at = self.ids.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or self.scores[at] > best[0]):
                    best = (self.scores[at], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def joins(self, left: int, right: int) -> bool:
        """Whether merging leaves these two pieces, each of which stands, side by side."""
        if left < 0 or right < 0:
            return True
        if (ok := self._pairs.get(left * self.stride + right)) is None:
            if len(self._pairs) >= _PAIRS:
                self._pairs.clear()
            ok = self._pairs[left * self.stride + right] = self._apart(self._texts[left], self._texts[right])
        return ok

    def _score(self, part: str) -> float:
        """Parts of a higher score are made earlier; single characters are there from the start."""
        return self.scores[self.ids[part]] if len(part) > 1 else float("inf")

    def _in_order(self, part: str) -> bool:
        """Whether scores fall from the halves of a part to the whole, throughout."""
        if len(part) < 2:
            return True
        if (ok := self._ordered.get(part)) is None:
            halves = self._halves.get(part)
            if halves is None and self.stands(self.ids[part]):
                halves = self._halves.get(part)
            ok = self._ordered[part] = halves is not None and all(self._score(x) > self._score(part) and self._in_order(x) for x in halves)
        return ok

    def _apart(self, a: str, b: str) -> bool:
        """Whether merging two pieces' text gives the two again.

        Until a merge crosses their border, either side is merged as if alone. So of the parts that meet at the border, from
        the whole pieces back to single characters, none may be a pair that goes before the merges that end either part.
        """
        if not (self._in_order(a) and self._in_order(b)):
            return self.merge(a + b) == [a, b]
        ids, scores, halves, score = self.ids, self.scores, self._halves, self._score
        of_a, of_b, after_a, after_b = score(a), score(b), float("-inf"), float("-inf")
        while True:
            at = ids.get(a + b)
            # Of equal scores the leftmost goes first.
            if at is not None and scores[at] > after_a and scores[at] >= after_b:
                return False
            if of_a < of_b:
                after_a, a = of_a, halves[a][1]
                of_a = score(a)
            elif len(b) > 1:
                after_b, b = of_b, halves[b][0]
                of_b = score(b)
            else:
                return True

    def stands(self, piece: int) -> bool:
        """Whether merging makes this piece of its own text."""
        if (ok := self._whole.get(piece)) is None:
            text = self._texts[piece]
            parts = [text] if self.unigram else self.merge(text, 2)
            ok = self._whole[piece] = 0 < len(parts) < 3
            if len(parts) == 2:
                self._halves[text] = (parts[0], parts[1])
        return ok

    def forward(self, text: str, start: int, last: int, stop: int) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
        """Best values of positions from ``start``, after piece ``last``, to ``stop``, and the piece and place before each.

        Unknown characters are pieces of their own, numbered -1 - code point.
        """
        value, back = {start: 0.0}, {start: (start, last)}
        get = self.ids.get
        for end in range(start + 1, stop + 1):
            best = None
            for size in range(min(self.longest, end - start), 0, -1):
                begin = end - size
                if begin not in value:
                    continue
                piece = get(text[begin:end])
                if piece is None:
                    if size > 1 or get(text[begin:end]) is not None:
                        continue
                    found = (value[begin] + (self.low if self.unigram else 0), begin, -1 - ord(text[begin]))
                elif self.stands(piece) and (self.unigram or self.joins(back[begin][1], piece)):
                    found = (value[begin] + (self.scores[piece] if self.unigram else 0), begin, piece)
                else:
                    continue
                if best is None or found[0] > best[0]:
                    best = found
                if not self.unigram:
                    break
            if best:
                value[end], back[end] = best[0], best[1:]
        return value, back

    def whole(self, text: str) -> list[int]:
        """Path of a text that stands alone; as ``forward`` from its beginning, without values where those are 0 or minus infinity."""
        if self.unigram:
            back = self.forward(text, 0, -1, len(text))[1]
            return self.trace(back, 0, len(text))
        root, joins, pairs, stride, n = self.trie, self.joins, self._pairs, self.stride, len(text)
        last: list[int | None] = [-1] + [None] * n
        begins = [0] * (n + 1)
        for begin in range(n):
            left = last[begin]
            if left is None:
                continue
            node, end = root, begin
            for letter in text[begin:]:
                node = node.get(letter)
                if node is None:
                    break
                end += 1
                piece = node.get("")
                if piece is not None and last[end] is None and (left < 0 or ((ok := pairs.get(left * stride + piece)) is not False and (ok or joins(left, piece)))):
                    last[end], begins[end] = piece, begin
            if last[begin + 1] is None and text[begin] not in self.ids:
                last[begin + 1], begins[begin + 1] = -1 - ord(text[begin]), begin
        path, end = [], len(text)
        while end:
            path.append(last[end])
            end = begins[end]
        return self.as_ids(path[::-1])

    def trace(self, back: dict[int, tuple[int, int]], start: int, end: int) -> list[int]:
        path = []
        while end > start:
            end, piece = back[end]
            path.append(piece)
        return self.as_ids(path[::-1])

    def as_ids(self, path: list[int]) -> list[int]:
        """Ids of a path; an unknown character becomes its bytes, or the unknown id if there are no byte pieces."""
        if all(p >= 0 for p in path):
            return path
        out: list[int] = []
        for p in path:
            if p >= 0:
                out.append(p)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-1 - p).encode("utf-8", "replace")]
            elif out[-1:] != [self.unknown]:
                out.append(self.unknown)
        return out

    def normal(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def encoder(model: bytes) -> Encoder:
    """The encoder of a worker: what it has learnt of words and pairs serves later tasks too, until another operator or model comes."""
    return kept(("pieces", model), lambda: Encoder(Pieces(model)))


class Encoder:
    """Encodes texts; words met before are kept, within a bound, as bytes of little-endian 32-bit ids."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        alone = "" if "\n" in pieces.ids or any("\n" in p for p in pieces.ids) else "\n"
        self.word = re.compile(f"{alone}|{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" if alone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if pieces.by_word else re.compile(r"(?s).+")

    def _keep(self, text: str, ids: bytes) -> bytes:
        if len(self.known) >= _CACHE // 2:
            self.known, self.older = {}, self.known
        self.known[text] = ids
        return ids

    def segment(self, text: str) -> bytes:
        """Ids of a word; those of a long one, or one with unknown characters, from the parts between which no piece can lie."""
        if (got := self.known.get(text)) is not None:
            return got
        if (got := self.older.get(text)) is not None:
            return self._keep(text, got)
        p = self.pieces
        if len(text) <= _SHORT and not p.unigram and p.letters.issuperset(text):
            return self._short(text)
        inner, begin, out = p.inner, 0, []
        for at in range(1, len(text)):
            if text[at - 1 : at + 1] not in inner:
                out.append(self._part(text[begin:at]))
                begin = at
        if not begin:
            return self._part(text)
        out.append(self._part(text[begin:]))
        ids = b"".join(out)
        return self._keep(text, ids) if len(text) <= _SHORT else ids

    def _part(self, text: str) -> bytes:
        if (got := self.known.get(text)) is None and (got := self.older.get(text)) is None:
            got = np.array(self.pieces.whole(text), "<i4").tobytes()
            if len(text) <= _SHORT:
                self._keep(text, got)
        return got

    def _short(self, text: str) -> bytes:
        """Best path of a short text of known characters: of all pieces at its end one may stand after the best path before it.

        Values are 0 or minus infinity, as in ``Pieces.whole``; the paths before are kept, since words share their beginnings.
        """
        node, found = self.pieces.ends, []
        for letter in reversed(text):
            node = node.get(letter)
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        joins, pairs, stride = self.pieces.joins, self.pieces._pairs, self.pieces.stride
        for piece, own, size in reversed(found):
            if size == len(text):
                return self._keep(text, own)
            head = text[:-size]
            before = self.known.get(head) or self.older.get(head) or self._short(head)
            left = int.from_bytes(before[-4:], "little")
            if (ok := pairs.get(left * stride + piece)) or ok is None and joins(left, piece):
                return self._keep(text, before + own)
        raise ValueError(f"no path through {text!r}")

    def encode(self, text: str) -> np.ndarray:
        known, segment = self.known, self.segment
        return np.frombuffer(b"".join([known.get(word) or segment(word) for word in self.word.findall(self.pieces.normal(text))]), "<i4")

    # Chunks: ``text`` is a window of the normal form, ``begin`` and ``end`` the chunk's place in it.

    def _cuts(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """First and last place in the chunk where every path has a piece's end."""
        if not self.pieces.by_word:
            return None
        found = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", text) if begin <= m.start() <= end]
        return (found[0], found[-1]) if found else None

    def states(self, text: str, cut: int) -> list[State]:
        """Pieces that can begin before ``cut`` and end at or after it: how far they reach beyond it, and which they are."""
        p, out = self.pieces, []
        for over in range(min(p.longest, len(text) - cut + 1)):
            for size in range(over + 1, p.longest + 1):
                if cut + over - size < 0:
                    break
                piece = p.ids.get(text[cut + over - size : cut + over])
                if piece is not None and p.stands(piece):
                    out.append((over, piece))
                elif size == 1 and piece is None and cut + over - size < cut:
                    out.append((over, -1 - ord(text[cut + over - 1])))
        return list(dict.fromkeys((over, -1) if p.unigram else (over, piece) for over, piece in out))

    def _exits(self, text: str, start: int, last: int, end: int, final: bool) -> dict[State, float]:
        """States at the chunk's end and their values, for paths from ``start``; at the text's end only its very end counts."""
        p = self.pieces
        value, back = p.forward(text, start, last, end if final else min(len(text), end + p.longest - 1))
        if start > end or (start == end and not final):
            # The piece that came in lies across this whole chunk.
            return {(start - end, -1 if p.unigram else last): 0.0}
        out: dict[State, float] = {}
        for at in sorted(x for x in value if x >= end):
            if at > start and back[at][0] < end or at == start:
                state = (at - end, -1 if p.unigram else back[at][1])
                out[state] = max(out.get(state, value[at]), value[at])
        # Another way to the same place may begin before the cut with another piece.
        if not final:
            for over, piece in self.states(text, end):
                if piece == -1 or (over, piece) in out:
                    continue
                size = len(p._texts[piece]) if piece >= 0 else 1
                begin = end + over - size
                if start <= begin < end and begin in value and p.joins(back[begin][1], piece):
                    out[over, piece] = value[begin]
        return out

    def transfer(self, text: str, begin: int, end: int, first: bool, final: bool) -> Matrix:
        entries = [_START] if first else self.states(text, begin)
        cuts = self._cuts(text, begin, end)
        if cuts is None:
            rows = {s: self._exits(text, begin + s[0], s[1], end, final) for s in entries}
            return {s: r for s, r in rows.items() if r}
        tail = self._exits(text, cuts[1], -1, end, final) if cuts[1] < end or final else None
        out: Matrix = {}
        for s in entries:
            if begin + s[0] > cuts[0]:
                continue
            value, back = self.pieces.forward(text, begin + s[0], s[1], cuts[0])
            if cuts[0] in value:
                if tail is None:  # the last cut is the chunk's end
                    ends = self._exits(text, begin + s[0], s[1], end, final) if cuts[0] == end else self._exits(text, self._before(text, cuts), -1, end, final)
                    out[s] = {t: v + (value[cuts[0]] if cuts[0] != end else 0) for t, v in ends.items()}
                else:
                    out[s] = {t: v + value[cuts[0]] for t, v in tail.items()}
        return out

    def _before(self, text: str, cuts: tuple[int, int]) -> int:
        """The last place before the last one where every path has a piece's end."""
        return max(m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", text) if cuts[0] <= m.start() < cuts[1])

    def backtrace(self, text: str, begin: int, end: int, entry: State, leave: State) -> list[int]:
        """Ids of the pieces that begin in the chunk, on the path between two states."""
        p = self.pieces
        start, stop = begin + entry[0], end + leave[0]
        if start >= end:
            return []
        size = len(p._texts[leave[1]]) if leave[1] >= 0 else 1
        if not p.unigram and leave != _START:
            head = self._path(text, start, entry[1], stop - size)
            return head + p.as_ids([leave[1]])
        return self._path(text, start, entry[1], stop)

    def _path(self, text: str, start: int, last: int, stop: int) -> list[int]:
        cuts = self._cuts(text, start, stop)
        if cuts is None:
            return self.pieces.trace(self.pieces.forward(text, start, last, stop)[1], start, stop)
        first = self.pieces.trace(self.pieces.forward(text, start, last, cuts[0])[1], start, cuts[0])
        out = list(first)
        for word in self.word.findall(text[cuts[0] : cuts[1]]):
            out += np.frombuffer(self.segment(word), "<i4").tolist()
        return out + self.pieces.trace(self.pieces.forward(text, cuts[1], -1, stop)[1], cuts[1], stop)


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Product in the max-plus semiring."""
    out: Matrix = {}
    for s, row in a.items():
        best: dict[State, float] = {}
        for t, v in row.items():
            for u, w in b.get(t, {}).items():
                if v + w > best.get(u, float("-inf")):
                    best[u] = v + w
        if best:
            out[s] = best
    return out


def resolve(matrices: list[Matrix], entry: State, leave: State) -> list[State]:
    """States before each matrix, and after the last, on the best path between two states."""
    ahead = [{entry: 0.0}]
    for m in matrices:
        ahead.append(combine({_START: ahead[-1]}, m).get(_START, {}))
    path = [leave]
    for m, before in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        options = [(v + m[s][path[-1]], s) for s, v in before.items() if path[-1] in m.get(s, {})]
        path.append(max(options, key=lambda x: x[0])[1])
    return path[::-1]


def _pack(m: Matrix) -> list[dict]:
    return [{"a": s[0], "p": s[1], "b": t[0], "q": t[1], "v": v} for s, row in m.items() for t, v in row.items()]


def _unpack(rows) -> Matrix:
    out: Matrix = {}
    for r in rows:
        out.setdefault((r["a"], r["p"]), {})[r["b"], r["q"]] = r["v"]
    return out


_CELLS = "array<struct<a:int,p:int,b:int,q:int,v:double>>"
_CELL_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("p", pa.int32()), ("b", pa.int32()), ("q", pa.int32()), ("v", pa.float64())]))


def _encode_small(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return run


def _split(shared, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(shared.value).pieces
        margin = pieces.longest
        for batch in batches:
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                whole = pieces.normal(text)
                count = -(-len(whole) // chunk)
                for n in range(count):
                    a = max(0, n * chunk - margin)
                    window = whole[a : min(len(whole), (n + 1) * chunk + margin)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "key": [key], "chunk": pa.array([n], pa.int32()), "chunks": pa.array([count], pa.int32()), "window": [window], "begin": pa.array([n * chunk - a], pa.int32()), "end": pa.array([min(len(whole), (n + 1) * chunk) - a], pa.int32())})

    return run


def _transfers(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            rows = batch.to_pylist()
            cells = [_pack(coder.transfer(r["window"], r["begin"], r["end"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1)) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "chunk")), pa.array(cells, _CELL_TYPE)], ["doc_id", "key", "chunk", "cells"])

    return run


def _product(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    total: Matrix | None = None
    for cells in pdf["cells"]:
        m = _unpack(cells)
        total = m if total is None else combine(total, m)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "doc": [pdf["doc"].iloc[0]], "block": [pdf["block"].iloc[0]], "cells": [_pack(total or {})]})


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of each block of a text."""
    pdf = pdf.sort_values("block")
    matrices = [_unpack(c) for c in pdf["cells"]]
    total = matrices[0]
    for m in matrices[1:]:
        total = combine({_START: total.get(_START, {})}, m)
    leave = max(total[_START].items(), key=lambda x: x[1])[0]
    path = resolve(matrices, _START, leave)
    return pd.DataFrame({"key": pdf["key"], "doc": pdf["doc"], "block": pdf["block"], "ea": [s[0] for s in path[:-1]], "ep": [s[1] for s in path[:-1]], "la": [s[0] for s in path[1:]], "lp": [s[1] for s in path[1:]]})


def _inside(pdf: pd.DataFrame) -> pd.DataFrame:
    """States at the ends of each chunk of a block."""
    pdf = pdf.sort_values("chunk")
    row = pdf.iloc[0]
    path = resolve([_unpack(c) for c in pdf["cells"]], (int(row["ea"]), int(row["ep"])), (int(row["la"]), int(row["lp"])))
    return pd.DataFrame({"key": pdf["key"], "doc": pdf["doc"], "chunk": pdf["chunk"], "ea": [s[0] for s in path[:-1]], "ep": [s[1] for s in path[:-1]], "la": [s[0] for s in path[1:]], "lp": [s[1] for s in path[1:]]})


def _backtraces(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for batch in batches:
            ids = [coder.backtrace(r["window"], r["begin"], r["end"], (r["ea"], r["ep"]), (r["la"], r["lp"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc", "chunk", "chunks")), pa.array(ids, pa.list_(pa.int32()))], ["key", "doc", "chunk", "chunks", "ids"])

    return run


def encode(docs: DataFrame, model: bytes, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, ids)``, one row for each row of ``docs``: the ids that SentencePiece gives for the whole text.

    ``model`` is the content of a model file. Texts of more than ``giant`` characters are encoded in chunks of ``chunk``,
    all others at once. Null and empty texts have no ids. Null ids and repeated rows are encoded like others; an empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    large = F.coalesce(F.char_length("text") > giant, F.lit(False))
    small = rows.where(~large).mapInArrow(_encode_small(shared), "doc_id bigint, ids array<int>")
    # A row is known by its id and text; repeated rows are encoded once and then repeated.
    giants = rows.where(large).withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.sha2("text", 256)))
    once = giants.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    split = "doc_id bigint, key string, chunk int, chunks int, window string, begin int, end int"
    parts = once.select("doc_id", "key", "text").mapInArrow(_split(shared, chunk), split).repartition("key", "chunk")
    cells = parts.mapInArrow(_transfers(shared), f"doc_id bigint, key string, chunk int, cells {_CELLS}")
    cells = cells.select("key", F.coalesce("doc_id", F.lit(0)).alias("doc"), "chunk", F.floor(F.col("chunk") / BLOCK).cast("int").alias("block"), "cells")
    blocks = cells.groupBy("key", "block").applyInPandas(_product, f"key string, doc bigint, block int, cells {_CELLS}")
    ends = blocks.groupBy("key").applyInPandas(_ends, "key string, doc bigint, block int, ea int, ep int, la int, lp int")
    states = cells.join(ends.drop("doc"), ["key", "block"]).groupBy("key", "block").applyInPandas(_inside, "key string, doc bigint, chunk int, ea int, ep int, la int, lp int")
    traced = parts.drop("doc_id").join(states, ["key", "chunk"]).mapInArrow(_backtraces(shared), "key string, doc bigint, chunk int, chunks int, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
    joined = once.select("key", "doc_id", "times").join(whole, "key")
    repeated = joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("doc_id", "ids")
    return small.unionByName(repeated)


def _rows_of_ids(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    """Slices of a batch with each row's ids."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        column = part.column(part.schema.get_field_index("ids"))
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        yield part, [flat[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``; null ids give null, no ids the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(shared.value).pieces
        for batch in batches:
            for part, ids in _rows_of_ids(batch):
                texts = [None if x is None else pieces.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return encoded.mapInArrow(run, f"{', '.join(f'`{c}` {t}' for c, t in encoded.dtypes)}, decoded string")


def digest(encoded: DataFrame, model: bytes) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ids as little-endian 32-bit numbers, texts as UTF-8."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(shared.value).pieces
        for batch in batches:
            for part, ids in _rows_of_ids(batch):
                sums = [hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
                texts = [hashlib.sha256(pieces.decode(x.tolist()).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
