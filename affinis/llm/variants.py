"""Spelling variants: words one edit apart, by a positional q-gram index with a count filter.

Two words that differ by one edit share at least ``length of the longer - 3`` bigrams at places that differ by at most 1, as an edit touches two bigrams at most. So of each word's
rarest bigrams a few must be shared: words are dealt to the index under every set of ``SHARED`` bigrams of that prefix. Within a part of the index, postings by bigram and place are merged in a heap for each word under the limits of length
and place; pairs at or above the overlap bound are verified, and given out in one part alone. Parts of more than ``BLOCK`` words are split into blocks, of which each pair is compared,
so no part is one task's.

Null texts have no words; a null id counts as an empty one; repeated rows count each. Empty tables give no words. Columns of other names are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .runtime import cut, stored

#: Letters of lower-cased texts.
LETTERS = r"a-z\u00C0-\u00FF"
#: Words that a task counts before it hands its counts on: a memory bound.
MOST_COUNTED = 200_000
#: Bigrams that a pair must share in both prefixes (as many as short words allow), words of a block, and counters of bigrams (they only order them).
SHARED, BLOCK, COUNTERS = 3, 1024, 1 << 16
#: Bigrams that one edit may touch.
TOUCHED = 2


def count_words(docs: DataFrame, slip: int | None = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """``(word, n)``: words of at least ``shortest`` letters that occur ``least`` times.

    Words are runs of letters, lower-cased in A-Z. With ``slip``, a run loses one letter where the CRC of id and run is a multiple of it; the CRC also tells which.
    """
    run_of = f"[{LETTERS}]{{{shortest},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, found = re.compile(run_of), Counter()

        def written() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                # bytes.lower() changes A-Z alone.
                own = Counter(runs.findall(text.as_py().encode().lower().decode()))
                if slip:
                    head = zlib.crc32(f"{'' if i is None else i}:".encode())
                    for word in [w for w in own if zlib.crc32(w.encode(), head) % slip == 0]:
                        at = zlib.crc32(word.encode(), head) % len(word)
                        n = own.pop(word)
                        if len(word) > shortest:
                            found[word[:at] + word[at + 1 :]] += n
                for word, n in own.items():
                    found[word] += n
                if len(found) > MOST_COUNTED:
                    yield written()
        yield written()

    counts = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _tokens(word: str) -> list[tuple[str, int]]:
    """Bigrams with their number among the equal ones before."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(word) - 1):
        gram = word[i : i + 2]
        k = seen.get(gram, 0)
        seen[gram] = k + 1
        out.append((gram, k))
    return out


def _counter(gram: str, k: int) -> int:
    return zlib.crc32(f"{gram}{'+' if k else ''}".encode()) % COUNTERS


def bigram_counts(words: DataFrame) -> np.ndarray:
    """Words by hashed bigram; repeated ones in a word count apart. A fixed number of counters, whatever the letters are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = np.zeros(COUNTERS, np.int64), {}
        for batch in batches:
            found = []
            for word in batch.column(0).to_pylist():
                for gram, k in _tokens(word):
                    key = (gram, k > 0)
                    if key not in places:
                        if len(places) > COUNTERS:
                            places.clear()
                        places[key] = _counter(gram, k)
                    found.append(places[key])
            total += np.bincount(found, minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["counter", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for row in words.select("word").mapInArrow(run, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        out[row["counter"]] = row["n"]
    return out


def _dealt(counts: np.ndarray, bare: bool = False):
    """A function that deals words ``(word, n)`` to parts: a row for each part, ``bare`` ones of part and size alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: dict[tuple[str, int], tuple[int, int]] = {}

        def rank(token: tuple[str, int]) -> tuple[int, int]:
            if token not in ranks:
                if len(ranks) > COUNTERS:
                    ranks.clear()
                ranks[token] = int(counts[_counter(*token)]), xxh64_intdigest(f"{token[0]} {token[1]}") & 0xFFFFFFFF
            return ranks[token]

        for batch in batches:
            keys, sizes, takes, prints = [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                first = [h for _, h in sorted(map(rank, _tokens(word)))[: TOUCHED + SHARED]]
                for size, shorter in ((len(word), 0), (len(word) + 1, 1)):
                    for key in parts_of(first, size, shorter):
                        keys.append(key)
                        sizes.append(size)
                        takes.append(i)
                prints.append(struct.pack(f"{len(first)}I", *first))
            at = pa.array(takes, pa.int32())
            columns = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32())]
            if bare:
                yield pa.RecordBatch.from_arrays(columns, ["key", "size"])
                continue
            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(at), batch.column(1).take(at), pa.array(prints, pa.binary()).take(at)], ["key", "size", "word", "n", "first"])

    return run


def _shared(size: int) -> int:
    """Bigrams that pairs whose longer word has ``size`` letters must share at least, or ``SHARED``."""
    return min(SHARED, size - 1 - TOUCHED)


def prefix(first: Sequence[int], size: int, shorter: int) -> Sequence[int]:
    """The part of a word's rarest bigrams in which a pair must share enough; the shorter word of a pair has one bigram less to lose."""
    return first[: TOUCHED + _shared(size) - shorter]


def parts_of(first: list[int], size: int, shorter: int) -> list[int]:
    return [part(c, size) for c in combinations(sorted(set(prefix(first, size, shorter))), _shared(size))]


def part(shared: tuple[int, ...], size: int) -> int:
    digest = xxh64_intdigest(struct.pack(f"{len(shared) + 1}I", size, *shared))
    return digest - (1 << 64) if digest >> 63 else digest


def one_edit(longer: str, shorter: str) -> bool:
    """Whether two different words, the first as long or one letter longer, are one edit apart."""
    i = 0
    for a, b in zip(longer, shorter):
        if a != b:
            break
        i += 1
    return longer[i + 1 :] == shorter[i + (len(longer) == len(shorter)) :]


def _candidates(lists: list[list[int]], need: int) -> list[int]:
    """Members of at least ``need`` of the sorted ``lists``, ascending.

    Such a member is in one of any ``len(lists) - need + 1`` lists: the shortest are merged in a heap, and the others are searched for what they give.
    """
    if len(lists) < need:
        return []
    lists.sort(key=len)
    few = len(lists) - need + 1
    out = []
    for j, same in groupby(heapq.merge(*lists[:few])):
        hits = sum(1 for _ in same)
        for left, found in enumerate(lists[few:], few):
            if hits + len(lists) - left < need:
                break
            at = bisect_left(found, j)
            hits += at < len(found) and found[at] == j
        if hits >= need:
            out.append(j)
    return out


def _near(words: list[str], blocks: list[int], size: int, same: bool) -> Iterator[tuple[int, int]]:
    """Pairs, by number and the longer first, one edit apart among the words of one part whose longer word has ``size`` letters; with ``same`` false only those between different blocks."""
    order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
    begin = next((at for at, i in enumerate(order) if len(words[i]) == size), len(order))
    if begin == len(order):
        return
    need = size - 1 - TOUCHED
    # Postings by place and bigram: of words one letter shorter, and of those of equal length before.
    short: list[dict[str, list[int]]] = [{} for _ in range(size)]
    equal: list[dict[str, list[int]]] = [{} for _ in range(size)]
    for at in range(begin):
        word = words[order[at]]
        for p in range(size - 2):
            # An inserted letter moves what follows it by one.
            gram = word[p : p + 2]
            short[p].setdefault(gram, []).append(at)
            here = short[p + 1].setdefault(gram, [])
            if not here or here[-1] != at:
                here.append(at)
    for at in range(begin, len(order)):
        i = order[at]
        word = words[i]
        grams = [word[p : p + 2] for p in range(size - 1)]
        # A replaced letter moves nothing.
        for postings, some in ((short, begin), (equal, at - begin)):
            if some:
                for other in _candidates([found for p, gram in enumerate(grams) if (found := postings[p].get(gram))], need):
                    j = order[other]
                    if (same or blocks[i] != blocks[j]) and words[j] != word and one_edit(word, words[j]):
                        yield i, j
        if at + 1 < len(order):
            for p, gram in enumerate(grams):
                equal[p].setdefault(gram, []).append(at)


LINK = "a string, n_a bigint, b string, n_b bigint"


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that none ends within a part, and where parts begin and end; rows come sorted by part."""
    names = ("key", "size", "one", "two")
    held: list[pa.RecordBatch] = []

    def cuts(batch: pa.RecordBatch) -> np.ndarray:
        change = np.zeros(batch.num_rows - 1, bool)
        for name in names:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.concat_batches([*held, batch])
        at = cuts(batch)
        held = [batch.slice(at[-1])]
        if at[-1]:
            yield batch.slice(0, at[-1]), at
    for batch in held:
        yield batch, np.append(cuts(batch), batch.num_rows)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of all parts of a task."""
    for batch, at in _whole_parts(batches):
        words, blocks, sizes, keys = (batch.column(c).to_pylist() for c in ("word", "mine", "size", "key"))
        same = (batch.column("one").to_numpy() == batch.column("two").to_numpy()).tolist()
        first = batch.column("first")
        a, b = [], []
        several = np.flatnonzero(np.diff(at) > 1)
        for begin, end in zip(at[several].tolist(), at[several + 1].tolist()):
            size = sizes[begin]
            for i, j in _near(words[begin:end], blocks[begin:end], size, same[begin]):
                i, j = begin + i, begin + j
                x, y = (prefix(struct.unpack(f"{len(f) // 4}I", f), size, size - len(words[k])) for k, f in ((k, first[k].as_py()) for k in (i, j)))
                # A pair may meet in several parts: it counts in that of its least bigrams.
                if part(tuple(sorted(set(x) & set(y))[: _shared(size)]), size) == keys[begin]:
                    a.append(i)
                    b.append(j)
        a, b = pa.array(a, pa.int32()), pa.array(b, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(which) for which in (a, b) for c in ("word", "n")], ["a", "n_a", "b", "n_b"])


def near_words(words: DataFrame) -> DataFrame:
    """``(a, n_a, b, n_b)``: each pair of distinct words ``(word, n)`` of 5 letters or more that are one edit apart, once."""
    counts, words = bigram_counts(words), words.select("word", "n")
    dealt = words.mapInArrow(_dealt(counts), "key bigint, size int, word string, n bigint, first binary")
    large = stored(words.mapInArrow(_dealt(counts, bare=True), "key bigint, size int").groupBy("key", "size").count().where(F.col("count") > BLOCK).select("key", "size", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    split = dealt.join(large, ["key", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", mine)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select("key", "size", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "word", "n", "first", "mine")
    by = ["key", "size", "one", "two"]
    return split.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compared, LINK)


def group_variants(words: DataFrame, ratio: int = 2, most_rounds: int = 64) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word ``(word, n)``.

    The form is the most frequent word one edit away (ties: the smallest in code-point order), if it occurs at least ``ratio`` times as often; the root is what forms lead to, by doubled pointers.
    """
    words = cut(words.select("word", "n"))
    both = near_words(words).select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_b").alias("n"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("n_a").alias("n"), F.col("a").alias("near")))).alias("l")).select("l.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("is_form", -F.col("best.less") >= ratio * F.col("n"))
    found = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"), F.when(F.col("is_form"), -F.col("best.less")).alias("form_n")))
    roots = found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(most_rounds):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"forms did not end in {most_rounds} rounds")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
