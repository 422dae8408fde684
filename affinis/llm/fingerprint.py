"""Document fingerprints by Order MinHash, in DataFrame functions only.

The k-mers of a text are numbered by occurrence, hashed and dealt to bins by their hash. For each bin the ``ell``
smallest ones are selected, kept in text order and hashed to one value, so that the fingerprint depends on the
order of what it keeps and is sensitive to edit distance. A bin that has fewer of its own takes the next ones of the bins that follow, so
that short texts fill all bins with tuples too. The share of equal bins is the likeness of two texts.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Bits of a packed position in a text, and those for texts of more tokens.
POSITION, POSITION_LONG = 24, 31
#: Quantiles of the ids by which rows are dealt to ranges, and bytes and rows for which one more range is opened.
QUANTILES, RANGE_BYTES, RANGE_ROWS = 256, 64 << 20, 50_000


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _occurrences(packed: Column, bits: int) -> Column:
    """For sorted ``hash << bits | position``: how many earlier entries have the same hash."""
    first = F.transform(packed, lambda x, i: F.when((i == 0) | (F.shiftright(x, bits) != F.shiftright(F.get(packed, F.greatest(i - 1, F.lit(0))), bits)), i))
    run = lambda heads: F.flatten(F.transform(heads, lambda at, j: F.sequence(F.lit(0), F.coalesce(F.get(heads, j + 1), F.size(packed)) - at - 1)))
    return _let(F.array_compact(first), run)


def order_minhash(text: Column, k: int = 3, ell: int = 2, bins: int = 64) -> Column:
    """Array of one 64-bit number for each of ``bins`` bins.

    Tokens are runs of up to 16 characters without ASCII white space; a text with fewer than ``k`` tokens is one
    k-mer, a null or blank one gives an empty array.
    """
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0))
    return _let(tokens, lambda w: F.when(F.size(w) <= 1 << POSITION, _of_tokens(w, k, ell, bins, POSITION)).otherwise(_of_tokens(w, k, ell, bins, POSITION_LONG)))


def _of_tokens(w: Column, k: int, ell: int, bins: int, bits: int) -> Column:
    rank = 63 - bits - max(1, (bins - 1).bit_length())
    place = lambda x: x.bitwiseAND((1 << bits) - 1)
    bin_of = lambda x: F.shiftright(x, bits + rank)

    def packed(w: Column) -> Column:
        n = F.size(w)
        low = (1 << (63 - bits)) - 1
        windows = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.shiftleft(F.xxhash64(*[F.get(w, i + j) for j in range(k)]).bitwiseAND(low), bits).bitwiseOR(i.cast("bigint")))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(windows))

    def numbered(s: Column) -> Column:
        # Bin, then bits of the hash of (k-mer, occurrence), then position: sorted, a bin's smallest come first.
        def entry(x: Column, occurrence: Column) -> Column:
            h = F.xxhash64(F.shiftright(x, bits), occurrence)
            own = F.shiftleft(F.pmod(h, F.lit(bins)), rank).bitwiseOR(F.shiftrightunsigned(h, 20).bitwiseAND((1 << rank) - 1))
            return F.shiftleft(own, bits).bitwiseOR(place(x))

        many = F.size(F.array_distinct(F.transform(s, lambda x: F.shiftright(x, bits)))) < F.size(s)
        none = F.transform(s, lambda x: entry(x, F.lit(0)))
        return F.array_sort(F.when(many, F.zip_with(s, _occurrences(s, bits), entry)).otherwise(none))

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < ell) | (bin_of(F.get(s, F.greatest(i - ell, F.lit(0)))) != bin_of(x)))

    def starts(s: Column) -> Column:
        """For each bin, where its entries begin, or those of the next bin that has any."""
        before = lambda i: F.when(i == 0, F.lit(-1).cast("bigint")).otherwise(bin_of(F.get(s, F.greatest(i - 1, F.lit(0)))))
        own = F.transform(s, lambda x, i: F.array_repeat(i, (bin_of(x) - before(i)).cast("int")))
        return F.concat(F.flatten(own), F.array_repeat(F.lit(0), (bins - 1 - bin_of(F.element_at(s, -1))).cast("int")))

    def tuples(s: Column) -> Column:
        def one(i: Column) -> Column:
            kept = F.slice(F.concat(F.slice(s, i + 1, F.lit(ell)), s), F.lit(1), F.least(F.lit(ell), F.size(s)))
            ordered = F.array_sort(F.transform(kept, lambda x: F.shiftleft(place(x), 63 - bits).bitwiseOR(F.shiftright(x, bits))))
            return F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND((1 << (63 - bits)) - 1)))

        return F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts(s), one))

    return _let(packed(w), lambda p: _let(numbered(p), lambda q: _let(smallest(q), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Share of bins with equal entries; 1 for two empty fingerprints, 0 for one."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a), F.size(b)))


def as_text(fingerprint: Column) -> Column:
    """Entries as 16 hexadecimal digits each, comma-joined."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def _ranged(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with the number ``_range`` of each row's range: ranges follow each other, from the highest to the lowest, as rows do in descending id and ascending hash.

    Ranges lie between quantiles of the id, and are divided further, by id, as the table grows. An id of several quantiles is hot: it has ranges of its own,
    divided by the hash.
    """
    quantiles = F.percentile_approx("_id", [i / QUANTILES for i in range(1, QUANTILES)], F.lit(100_000))
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("bytes"), F.min("_id").alias("low"), F.max("_id").alias("high"), quantiles.alias("bounds")).first()
    if not size["n"]:
        return docs.withColumn("_range", F.lit(0).cast("bigint"))
    parts = ceil(max((size["bytes"] or 0) / RANGE_BYTES, size["n"] / RANGE_ROWS) / QUANTILES) or 1
    slots = {b: size["bounds"].count(b) for b in size["bounds"]}
    bounds = sorted(slots | {size["high"]: 1})

    hot = [max(1, slots.get(b, 1)) * parts if slots.get(b, 1) > 1 else 0 for b in bounds]
    lows = [float(x) for x in [size["low"] - 1, *bounds[:-1]]]
    width = [max(1.0, float(b) - a) for a, b in zip(lows, bounds, strict=True)]
    spans = F.array(*[F.struct(F.lit(b).cast("bigint").alias("bound"), F.lit(h).alias("hot"), F.lit(a).alias("low"), F.lit(w).alias("width")) for b, h, a, w in zip(bounds, hot, lows, width, strict=True)])

    # Ids up to the i-th bound are in place i.
    def number(place: Column) -> Column:
        span = F.element_at(spans, place + 1)
        by_id = F.least(F.floor((F.col("_id").cast("double") - span["low"]) / span["width"] * parts), F.lit(parts - 1))
        unit = F.shiftrightunsigned("_hash", 1) / F.lit(float(1 << 63))
        by_hash = span["hot"] - 1 - F.least(F.floor(unit * span["hot"]), span["hot"] - 1)
        is_hot = (span["hot"] > 0) & (F.col("_id") == span["bound"])
        within = F.when(is_hot, by_hash).otherwise(F.greatest(by_id, F.lit(0)))
        return F.shiftleft((2 * place + is_hot.cast("int")).cast("bigint"), 40) + within.cast("bigint")

    place = F.aggregate(F.array(*[F.lit(b).cast("bigint") for b in bounds[:-1]]).cast("array<bigint>"), F.lit(0), lambda n, b: n + (b < F.col("_id")).cast("int"))
    return docs.withColumn("_range", _let(place, number))


def with_next(docs: DataFrame, column: str, extra: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``docs`` with the columns of ``extra`` and ``next``: a struct of ``column`` and them of the following row in descending ``doc_id``.

    ``extra`` are functions of ``column``. The first row follows the last. Rows are dealt to ranges of the order, so no task sorts the whole
    table; the last row of a range is followed by the first of the next one, looked up among one row per range. Equal ids follow each other in the
    order of a hash of ``column``.
    """
    docs = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_hash", F.xxhash64(column))
    ranged = _ranged(docs, column)
    whole = lambda c: F.struct(c.alias(column), *[f(c).alias(name) for name, f in extra.items()])
    # Halving keeps the hash's unsigned order in a signed number.
    order = [F.col("_id").desc(), F.shiftrightunsigned("_hash", 1), F.col(column)]
    here = W.partitionBy("_range").orderBy(*order)
    led = ranged.withColumns({name: f(F.col(column)) for name, f in extra.items()})
    led = led.withColumn("next", F.lead(F.struct(column, *extra)).over(here)).withColumn("_last", F.lead(F.lit(1)).over(here).isNull())
    first = F.min_by(column, F.struct(-F.col("_id").cast("decimal(20,0)"), F.shiftrightunsigned("_hash", 1), column))
    heads = ranged.groupBy("_range").agg(first.alias("_first"))
    chain = W.orderBy(F.col("_range").desc())
    ends = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    links = heads.select("_range").withColumn("_after", F.coalesce(F.lead("_range").over(chain), F.first("_range").over(ends)))  # a number for each range
    heads = links.join(heads.withColumnRenamed("_range", "_after"), "_after").select("_range", whole(F.col("_first")).alias("_head"))
    out = led.join(heads.withColumn("_last", F.lit(True)), ["_range", "_last"], "left").withColumn("next", F.coalesce("next", "_head"))
    return out.drop("_range", "_last", "_head", "_id", "_hash")


def fingerprints(docs: DataFrame, k: int = 3, ell: int = 2, bins: int = 64) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for each row of ``docs``.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by the first as many, or all, of the
    next document's in descending ``doc_id`` (after the last comes the first). Likenesses are from 0 to 1.

    A null text counts as empty. Null ids come last. Rows with equal ids follow each other by a hash of the text; repeated rows are rows of their own; a
    table of one row follows itself. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    paired = with_next(rows, "text", {"print": lambda text: order_minhash(text, k, ell, bins)})
    edited = paired.select("doc_id", n.cast("bigint").alias("n_chars"), "print", F.col("next.print").alias("next_print"), F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"))
    edited = edited.withColumn("edited_print", order_minhash(F.col("edited"), k, ell, bins))
    return edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).cast("double").alias("near_edited"), likeness(F.col("print"), F.col("next_print")).cast("double").alias("near_next"))
