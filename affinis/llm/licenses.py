"""License scans by template markup.

A template is a wording with markup: ``[...]`` is optional, ``{a-b}`` stands for a to b words of any kind (a replaceable region such as a holder's name)
and ``{x|y z}`` for one of some wordings; all else is mandatory. Templates are compiled into one automaton over words,
which reads a text once and accepts where a whole template has been read, its mandatory words without exception. Deterministic states are
made as texts need them. Where a template ends, its reversed automaton finds where it began.

Texts are lower-cased in A-Z; words are runs of letters, digits and characters beyond ASCII. Null and empty texts have no words, no places and score 0.
Repeated rows are scanned each. Columns of other names stay; those named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Deterministic states that a worker keeps, and arcs of a state: a memory bound, results do not depend on it.
MOST_STATES = 20_000


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text.translate(_LOWER)) if text else []


@dataclass(frozen=True)
class Template:
    """``kind`` tells whole phrases (``base``) from the wordings that the method adds; ``weight`` is what finding it is worth, from 0 to 1."""

    label: str
    markup: str
    kind: str = "notice"
    weight: float = 0.9

    @cached_property
    def parts(self) -> list:
        """The markup as a list of words, ``("gap", a, b)``, ``("any", [parts, ...])`` and ``("may", parts)``."""
        tokens = re.findall(r"\[|\]|\{[^}]*\}|[^\[\]{}]+", self.markup)
        stack: list[list] = [[]]
        for token in tokens:
            if token == "[":
                stack.append([])
            elif token == "]":
                if len(stack) < 2:
                    raise ValueError(f"{self.label}: ] without [")
                inner = stack.pop()
                stack[-1].append(("may", inner))
            elif token[0] == "{":
                inside = token[1:-1]
                if gap := re.fullmatch(r"\s*(\d+)-(\d+)\s*", inside):
                    stack[-1].append(("gap", int(gap[1]), int(gap[2])))
                else:
                    stack[-1].append(("any", [words_of(x) for x in inside.split("|")]))
            else:
                stack[-1].extend(words_of(token))
        if len(stack) > 1:
            raise ValueError(f"{self.label}: [ without ]")
        return stack[0]


#: Arc label of any word.
ANY = ""


class Automaton:
    """A machine over words for many templates, deterministic states made on demand."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.arcs: list[dict[str, set[int]]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, int] = {}
        self.firsts: list[int] = []
        for k, t in enumerate(templates):
            first = self._state()
            last = self._compile(t.parts, first)
            if last in self._closure({first}):
                raise ValueError(f"{t.label}: a template needs a mandatory word")
            self.firsts.append(first)
            self.ends[last] = k
        self.letters = {w for arcs in self.arcs for w in arcs if w != ANY}
        self._reset()

    def _state(self) -> int:
        self.arcs.append({})
        self.free.append(set())
        return len(self.arcs) - 1

    def _step(self, state: int, word: str) -> int:
        to = self._state()
        self.arcs[state].setdefault(word, set()).add(to)
        return to

    def _compile(self, parts: list, state: int) -> int:
        for part in parts:
            if isinstance(part, str):
                state = self._step(state, part)
            elif part[0] == "gap":
                way = state
                for _ in range(part[1]):
                    way = self._step(way, ANY)
                end = self._state()
                self.free[way].add(end)
                for _ in range(part[2] - part[1]):
                    way = self._step(way, ANY)
                    self.free[way].add(end)
                state = end
            else:
                ways = part[1] if part[0] == "any" else [part[1], []]
                lasts = [self._compile(way, state) if way else state for way in ways]
                state = self._state()
                for last in lasts:
                    self.free[last].add(state)
        return state

    def _closure(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return frozenset(seen)

    def _reset(self) -> None:
        self._start = self._closure(set(self.firsts))
        self._known: dict[frozenset[int], int] = {}
        self._sets: list[frozenset[int]] = []
        self._rows: list[dict[str, int]] = []
        self._accepts: list[tuple[int, ...]] = []
        self._number(self._start)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self._known:
            self._known[states] = len(self._sets)
            self._sets.append(states)
            self._rows.append({})
            self._accepts.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self._known[states]

    def _next(self, at: int, word: str) -> int:
        moved: set[int] = set()
        for s in self._sets[at]:
            arcs = self.arcs[s]
            moved |= arcs.get(word, set()) if word else set()
            moved |= arcs.get(ANY, set())
        to = self._number(self._closure(moved) | self._start)
        self._rows[at][word] = to
        return to

    @cached_property
    def _back(self) -> tuple[list[dict[str, set[int]]], list[set[int]]]:
        """Arcs and free moves, turned round."""
        arcs: list[dict[str, set[int]]] = [{} for _ in self.arcs]
        free: list[set[int]] = [set() for _ in self.arcs]
        for s, out in enumerate(self.arcs):
            for word, to in out.items():
                for t in to:
                    arcs[t].setdefault(word, set()).add(s)
        for s, out in enumerate(self.free):
            for t in out:
                free[t].add(s)
        return arcs, free

    def _began(self, words: list[str], end: int, template: int) -> int:
        """The least start of a place of ``template`` whose last word is ``end``."""
        arcs, free = self._back
        first = self.firsts[template]
        states = {s for s, k in self.ends.items() if k == template}
        best, i = end, end
        while True:
            seen, todo = set(states), list(states)
            while todo:
                for to in free[todo.pop()] - seen:
                    seen.add(to)
                    todo.append(to)
            if first in seen:
                best = i + 1
            if i < 0:
                return best
            states = set()
            for s in seen:
                states |= arcs[s].get(words[i], set()) | arcs[s].get(ANY, set())
            if not states:
                return best
            i -= 1

    def places(self, words: list[str]) -> list[tuple[int, int, int]]:
        """``(start, end, template)``, end exclusive, for every end of a template; of those that begin alike the longest."""
        letters, at, hits = self.letters, 0, []
        rows, accepts = self._rows, self._accepts
        for i, word in enumerate(words):
            word = word if word in letters else ANY
            to = rows[at].get(word)
            if to is None:
                if len(self._sets) > MOST_STATES:
                    here = self._sets[at]
                    self._reset()
                    rows, accepts = self._rows, self._accepts
                    at = self._number(here)
                to = self._next(at, word)
            at = to
            if accepts[at]:
                hits += [(i, k) for k in accepts[at]]
        longest: dict[tuple[int, int], int] = {}
        for i, k in hits:
            start = self._began(words, i, k)
            longest[start, k] = max(longest.get((start, k), 0), i + 1)
        return sorted((start, end, k) for (start, k), end in longest.items())


SCHEMA = "places array<struct<label: string, kind: string, weight: double, start: int, end: int>>, n_words bigint"


def scan(docs: DataFrame, templates: list[Template], column: str = "text") -> DataFrame:
    """``docs`` with ``n_words`` and ``places``: label, kind, weight, first word and end (exclusive) of every place, by start, end and the template's number."""

    keep = [c for c in docs.columns if c not in ("places", "n_words")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(templates)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(column))
            places, counts = [], []
            for text in texts:
                words = words_of(text.as_py())
                counts.append(len(words))
                places.append([{"label": templates[k].label, "kind": templates[k].kind, "weight": templates[k].weight, "start": a, "end": b} for a, b, k in machine.places(words)] if words else [])
            kind = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("weight", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, kind), pa.array(counts, pa.int64())], [*batch.schema.names, "places", "n_words"])

    plain = docs.select(*keep)
    return plain.mapInArrow(run, StructType(plain.schema.fields + StructType.fromDDL(SCHEMA).fields))


def digest(scanned: DataFrame) -> DataFrame:
    """A row for each text: its base places (number, first and last start, labels), all labels, and a score.

    The score is the greatest weight of a place: 1 for a whole license text, 0.9 for its notice, 0.8 for a reference by name, 0.5 for a base phrase alone, 0 for no place.
    """
    base = F.filter("places", lambda p: p["kind"] == "base")
    starts = F.transform(base, lambda p: p["start"].cast("bigint"))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p["weight"])), F.lit(0.0)).alias("score"),
    )


def as_regex(template: Template) -> str:
    """The template over words that each have a space before them, as a regular expression; the text ends in one more space."""

    def of(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, str):
                out += " " + part
            elif part[0] == "gap":
                out += f"(?: [^ ]+){{{part[1]},{part[2]}}}"
            elif part[0] == "any":
                out += "(?:" + "|".join(of(way) for way in part[1]) + ")"
            else:
                out += f"(?:{of(part[1])})?"
        return out

    return of(template.parts) + " "


# The phrases of the contract and public license wordings, as their licenses and the SPDX list print them.
BASE = [
    Template("mit", "under the mit license", "base", 0.5),
    Template("apache-2", "apache license version 2", "base", 0.5),
    Template("cc-by-nc", "cc by nc", "base", 0.5),
]
NAMES = [
    Template("mit", "{licensed|released|distributed|available|provided} under the [terms of the] mit {license|licence}", "name", 0.8),
    Template("apache-2", "{licensed|released|distributed|available|provided} under the [terms of the] apache {license|licence} [{v|version}] {2|2 0|2.0}", "name", 0.8),
    Template("bsd-2-clause", "{licensed|released|distributed|available|provided} under [the] [terms of the] [{simplified|freebsd}] bsd {2 clause|two clause} {license|licence}", "name", 0.8),
    Template("bsd-3-clause", "{licensed|released|distributed|available|provided} under [the] [terms of the] [{new|modified|revised}] bsd {3 clause|three clause} {license|licence}", "name", 0.8),
    Template("gpl-2", "{licensed|released|distributed|available|provided} under [the] [terms of the] {gnu general public license|gnu gpl|gpl} [{version|v}] {2|v2|2 0}", "name", 0.8),
    Template("gpl-3", "{licensed|released|distributed|available|provided} under [the] [terms of the] {gnu general public license|gnu gpl|gpl} [{version|v}] {3|v3|3 0}", "name", 0.8),
    Template("agpl-3", "{licensed|released|distributed|available|provided} under [the] [terms of the] {gnu affero general public license|gnu agpl|agpl} [{version|v}] {3|v3|3 0}", "name", 0.8),
    Template("lgpl", "{licensed|released|distributed|available|provided} under [the] [terms of the] {gnu lesser general public license|gnu lgpl|lgpl} [{version|v}] {2 1|v2 1|3|v3}", "name", 0.8),
    Template("mpl-2", "{licensed|released|distributed|available|provided} under the [terms of the] mozilla public license [{version|v}] {2|2 0}", "name", 0.8),
    Template("cc0-1", "{cc0 1 0|creative commons zero|public domain dedication}", "name", 0.8),
    Template("cc-by", "{licensed|released|distributed|available|provided} under [{a|the}] {cc by|creative commons attribution} {2 0|2 5|3 0|4 0} [{international|unported|generic}] [{license|licence}]", "name", 0.8),
    Template("cc-by-sa", "{licensed|released|distributed|available|provided} under [{a|the}] {cc by sa|creative commons attribution share alike|creative commons attribution sharealike} {2 0|2 5|3 0|4 0} [{international|unported|generic}] [{license|licence}]", "name", 0.8),
    Template("cc-by-nc", "{licensed|released|distributed|available|provided} under [{a|the}] {cc by nc|creative commons attribution non commercial|creative commons attribution noncommercial} {2 0|2 5|3 0|4 0} [{international|unported|generic}] [{license|licence}]", "name", 0.8),
    Template("mit", "spdx license identifier mit", "name", 0.8),
    Template("apache-2", "spdx license identifier apache 2 0", "name", 0.8),
    Template("bsd-2-clause", "spdx license identifier bsd 2 clause", "name", 0.8),
    Template("bsd-3-clause", "spdx license identifier bsd 3 clause", "name", 0.8),
    Template("gpl-2", "spdx license identifier gpl 2 0 {only|or later}", "name", 0.8),
    Template("gpl-3", "spdx license identifier gpl 3 0 {only|or later}", "name", 0.8),
    Template("mpl-2", "spdx license identifier mpl 2 0", "name", 0.8),
]
NOTICES = [
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {1-8} [http] [https] [www] apache.org/licenses/LICENSE-2.0 [html]"),
    Template("gpl-2", "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; [either] version 2 [of the License] [or (at your option) any later version]"),
    Template("gpl-3", "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation[, either] version 3 [of the License] [or (at your option) any later version]"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {0-2} mozilla.org/MPL/2.0"),
    Template("bsl-1", "Distributed under the Boost Software License, Version 1.0"),
]
TEXTS = [
    Template(
        "mit",
        "[The MIT License [(MIT)]] [Copyright [(c)] {0-20}] Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice [(including the next paragraph)] shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,"
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {the authors or copyright holders|the copyright holders|the authors} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "text", 1.0,
    ),
    Template(
        "isc",
        "[ISC License] [Copyright [(c)] {0-20}] Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED \"AS IS\" AND {isc|the author} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "text", 1.0,
    ),
    *[
        Template(
            label,
            "[Copyright [(c)] {0-20}] Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [1] Redistributions of source code must retain the above copyright notice,"
            " this list of conditions and the following disclaimer. [2] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
            + third + "THIS SOFTWARE IS PROVIDED BY {1-10} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
            "text", 1.0,
        )
        for label, third in (("bsd-2-clause", ""), ("bsd-3-clause", "[3] Neither the name of {1-12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "))
    ],
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "text", 1.0,
    ),
]
TEMPLATES = BASE + NAMES + NOTICES + TEXTS
