"""MinHash near-duplicate detection with tensored banding.

Two small collections of hash groups (``left`` and ``right``, ``half`` groups of ``rows`` minhashes
each) are combined pair by pair into ``half * half`` table keys, so that the number of minhashes is
about the square root of what independent tables would need. Candidates are confirmed on full
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components, hub_join
from .runtime import cut, forget
from .words import WordHashes, mix, shingles

#: Buckets of up to this many documents are compared pair by pair, larger ones with a few heads and, where these leave them apart, in blocks.
SMALL = 32
#: Orders in which the first member of a large bucket is a head of it. More heads leave fewer members apart, for more pairs.
HEADS = 1
#: Members of a block and shingles of its sets, about.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000

#: Size of the filter for documents whose sets are needed. At any number of documents it is correct; the more, the less it saves.
BITMAP_BYTES = 1 << 22

_SIGNATURE = "doc_id bigint, cls string, n_shingles bigint, lefts array<bigint>, rights array<bigint>, sketch array<tinyint>"


class Tensor:
    """Parameters of the tensored tables: ``half`` groups of ``rows`` minhashes on either side.

    A pair of Jaccard similarity s meets in a table with probability (1 - (1 - s**rows)**half)**2;
    for s = 0.85 and the defaults it is missed about twice in 100,000, for s = 0.9 three times in 10,000,000.
    """

    def __init__(self, rows: int = 3, half: int = 12, seed: int = 1):
        self.rows, self.half = rows, half
        rng = np.random.default_rng(seed)
        n = 2 * rows * half
        self.mul = (rng.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1).astype(np.uint32)
        self.add = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.salt = rng.integers(0, 2**63, (2 * half, rows), dtype=np.uint64) | np.uint64(1)

    def minhashes(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(sets), len(self.mul)), 2**32 - 1, np.uint32)
        for row, values in zip(out, sets, strict=True):
            x = (values >> np.uint64(32)).astype(np.uint32)[:, None]
            for i in range(0, len(x), 256):
                np.minimum(row, (x[i : i + 256] * self.mul + self.add).min(0), out=row)
        return out

    def groups(self, minhashes: np.ndarray) -> np.ndarray:
        """One 64-bit value for each group, left ones first."""
        m = minhashes.reshape(len(minhashes), 2 * self.half, self.rows).astype(np.uint64)
        return mix((m * self.salt).sum(2, dtype=np.uint64)).view(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel(), kind))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _sign(tensor: Tensor, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        forget()
        hashes = WordHashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                words = [(t or b"").lower().split() for t in _texts(batch)]
                sets = [shingles(hashes.of(w), width) for w in words]
                mins = tensor.minhashes(sets)
                groups = tensor.groups(mins)
                cls = [xxhash.xxh3_128_hexdigest(b" ".join(w)) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("doc_id")), pa.array(cls), pa.array([len(s) for s in sets], pa.int64()), _lists(groups[:, : tensor.half], pa.int64()), _lists(groups[:, tensor.half :], pa.int64()), _lists((mins & np.uint32(255)).astype(np.uint8).view(np.int8), pa.int8())],
                    ["doc_id", "cls", "n_shingles", "lefts", "rights", "sketch"],
                )

    return run


def bit_of(column: str) -> Column:
    """Number of an id's bit, from 1."""
    return F.pmod(F.xxhash64(column), F.lit(8 * BITMAP_BYTES)) + 1


def bit_table(ids: DataFrame) -> DataFrame:
    """Parts of the bitmap that have bits set, of 4 KB each: all together ``BITMAP_BYTES`` at most."""
    bit = bit_of("id")
    return ids.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def bitmap(ids: DataFrame) -> Broadcast[np.ndarray]:
    """Bits at the hashes of all ``id``: of fixed size, a filter without false negatives."""
    bits = np.zeros(BITMAP_BYTES, np.uint8)
    for row in bit_table(ids).toLocalIterator():
        piece = np.frombuffer(row["bits"], np.uint8)
        bits[(row["part"] - 1) * len(piece) : row["part"] * len(piece)] = piece
    return ids.sparkSession.sparkContext.broadcast(bits)


def _shingle_sets(width: int, wanted: Broadcast[np.ndarray]):
    """Shingle sets of the documents whose bit is set: those wanted, and a few more by chance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes, bits = WordHashes(), wanted.value
        for whole in batches:
            # A bit at position p of its bucket is bit p % 8, from the lowest, of byte p // 8.
            at = whole.column("bit").to_numpy() - 1
            whole = whole.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0))
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = [shingles(hashes.of((t or b"").lower().split()), width) for t in _texts(batch)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "shingles"])

    return run


def linked(size_a: int, size_b: int | np.ndarray, shared: int | np.ndarray, percent: int):
    return 100 * shared >= percent * (size_a + size_b - shared)


def join_sets(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets whose Jaccard similarity reaches ``percent``, at most one fewer than there are sets.

    Sets of side 0 and 1 are compared with each other, and all with all where only one side occurs.
    Shingles are ordered by how rare they are here: two sets can only reach the threshold if
    they share one of the rarest ``n - ceil(percent / 100 * n) + 1`` of theirs. Sets that are linked already,
    among them those of equal ``joined``, are not compared.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64)
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    elements = [np.sort(rank[codes[starts[i] : starts[i + 1]]]) for i in range(n)]
    both = len(np.unique(side)) > 1
    root = np.arange(n) if joined is None else np.unique(joined, return_inverse=True)[1]
    postings, found = {}, []
    mark = np.zeros(len(counts), bool)
    for i in range(n):
        e = elements[i]
        if not len(e):
            continue
        prefix = e[: len(e) - -(-percent * len(e) // 100) + 1]
        near = [postings[x] for x in prefix.tolist() if x in postings]
        if near:
            others = np.unique(np.concatenate(near))
            others = others[root[others] != root[i]]
            if both:
                others = others[side[others] != side[i]]
            low, high = np.minimum(sizes[others], len(e)), np.maximum(sizes[others], len(e))
            others = others[100 * low >= percent * high]
            mark[e] = True
            for j in others.tolist():
                if root[j] != root[i] and linked(len(e), sizes[j], int(mark[elements[j]].sum()), percent):
                    found.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
            mark[e] = False
        for x in prefix.tolist():
            postings.setdefault(x, []).append(i)
    return found


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = table.column("shingles").combine_chunks()
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        pairs = join_sets(table.column("id").to_numpy(), table.column("side").to_numpy(), [flat[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)], percent, table.column("component").to_numpy())
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return run


def _apart(crowd: DataFrame, found: DataFrame, brief: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links between members of large buckets that the components ``found`` so far leave apart, None if there are no large buckets.

    Members of one component need no comparison. The others are taken together by the left half of their buckets: those outside the
    largest component there are compared with all others, in pairs of blocks of bounded size, on whole sets.
    """
    if crowd.isEmpty():
        return None
    spot = ["i", "x"]
    named = crowd.select("id", *spot).distinct().join(found, "id", "left").select("id", *spot, F.coalesce("component", "id").alias("component"))
    members = named.join(brief.select("id", "n_shingles"), "id")
    blocks = lambda n, w: F.ceil(n / BLOCK + w / BLOCK_SHINGLES).cast("int")
    sizes = members.groupBy(*spot, "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    per = sizes.groupBy(*spot).agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("parts > 1")
    per = per.select(*spot, F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.w")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("others"))
    members = cut(hub_join(members.drop("n_shingles"), per, *spot))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rest, main = members.where("component <> main"), members.where("component = main")
    columns = ["id", "component", *spot]
    x = rest.select(*columns, F.lit(0).alias("kind"), own("others").alias("b1"), each("mains").alias("b2"), F.lit(0).alias("side"))
    y = main.select(*columns, F.lit(0).alias("kind"), each("others").alias("b1"), own("mains").alias("b2"), F.lit(1).alias("side"))
    z = rest.withColumn("own", own("others")).withColumn("other", each("others")).select(*columns, F.lit(1).alias("kind"), F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    placed = x.unionByName(y).unionByName(z).join(sets.withColumnRenamed("doc_id", "id"), "id")
    return placed.groupBy(*spot, "kind", "b1", "b2").applyInArrow(_block_links(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tensor: Tensor | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row for each row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Words are runs without ASCII
    white space, A-Z lower-cased; a set holds the distinct ``width``-word shingles, or the
    whole sequence if it is shorter. Documents are linked if the Jaccard similarity of their sets is at least
    ``percent`` / 100; ``component_id`` is the smallest id that links reach.

    Null and empty texts have no shingles and are linked with nothing. Rows whose ``doc_id`` is null stand alone, with a
    null component, and are kept. Rows that repeat a ``doc_id`` with other texts are one document
    with the links of all of them. An empty table gives an empty result.
    """
    tensor = tensor or Tensor()
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_sign(tensor, width), _SIGNATURE))
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = usable.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    nodes = usable.join(classes, "cls").where(F.col("doc_id") == F.col("rep")).dropDuplicates(["cls"])
    nodes = cut(nodes.select(F.col("doc_id").alias("id"), "cls", "n_shingles", "lefts", "rights", "sketch"))

    # Tables of the left halves come first: what no other document shares there is in no bucket of a pair of halves.
    left = nodes.select("id", F.posexplode("lefts").alias("i", "x"))
    common = left.groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "x")
    shared_halves = hub_join(left, common, "i", "x").groupBy("id").agg(F.collect_list(F.struct("i", "x")).alias("halves"))
    halves = shared_halves.join(nodes.select("id", "rights"), "id").select("id", "rights", F.inline("halves"))
    cells = halves.select("id", "i", "x", F.posexplode("rights").alias("j", "y")).select("id", "i", "x", F.xxhash64("i", "x", "j", "y").alias("key"))
    counts = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = cut(hub_join(cells, counts, "key"))

    lists = cells.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    firsts = lists.select("ids", F.posexplode("ids").alias("p", "a"))
    pairs = firsts.select("a", F.explode(F.slice("ids", F.col("p") + 2, F.size("ids"))).alias("b")).distinct()
    brief = nodes.select("id", "n_shingles", "sketch")
    a = brief.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    b = brief.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    # A pair at the threshold agrees in so many minhashes, but for about one in a million.
    hashes, share = 2 * tensor.rows * tensor.half, percent / 100
    least = int(hashes * share - 5.6 * (hashes * share * (1 - share)) ** 0.5)
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, x: s + x)
    # A large bucket is compared with its heads, the first of its members in a few orders that all buckets share: pairs grow in proportion to the members.
    crowd = cut(cells.where(F.col("n") > SMALL).select("id", "i", "x", "key"))
    orders = [F.col("id") if k == 0 else F.xxhash64("id", F.lit(k)) for k in range(HEADS)]
    heads = crowd.groupBy("key").agg(F.array(*[F.min_by("id", o) for o in orders]).alias("heads"))
    headed = hub_join(crowd.select("id", "key"), heads, "key").groupBy("id").agg(F.collect_set("heads").alias("heads"))
    headed = headed.select("id", F.explode(F.array_distinct(F.flatten("heads"))).alias("head")).where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    pairs = pairs.unionByName(headed).distinct().join(a, "a").join(b, "b").where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (agree >= least)).select("a", "b")
    pairs = cut(pairs)

    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(crowd.select("id")).distinct()
    sets = cut(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", bit_of("doc_id").alias("bit")).mapInArrow(_shingle_sets(width, bitmap(wanted)), "doc_id bigint, shingles array<bigint>"))

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    confirmed = cut(pairs.join(one, "a").join(two, "b").where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    found = components(confirmed)
    within = _apart(crowd, found, brief, sets, percent)

    # A document that occurs with several texts belongs to each one's class.
    several = usable.groupBy("doc_id").agg(F.min("cls").alias("c1"), F.max("cls").alias("c2")).where("c1 <> c2").select("doc_id")
    same = usable.select("doc_id", "cls").join(several, "doc_id", "left_semi").join(classes, "cls").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))

    # What blocks and repeated ids add are links between the components found so far.
    more = same if within is None else same.unionByName(within)
    label = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"to_{end}"))
    more = cut(more.where("a <> b"))
    if more.isEmpty():
        found = found.withColumnRenamed("id", "rep")
    else:
        more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select("a", "b", F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        ends = found.select("id", F.col("component").alias("old")).unionByName(more.select(F.col("a").alias("id"), F.col("x").alias("old"))).unionByName(more.select(F.col("b").alias("id"), F.col("y").alias("old"))).distinct()
        found = ends.join(components(more.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("id", "old"), "old", "left").select(F.col("id").alias("rep"), F.coalesce("component", "old").alias("component"))
    home = classes.join(found, "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("cls")).alias("cls"))
    alone = rows.where(F.col("cls").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = rows.where(F.col("cls").isNotNull()).join(home, "cls").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return rest.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Bits of a document's key that tell the texts of one id apart.
TEXT_BITS = 25


def document_key(doc_id: Column, text: Column) -> Column:
    """A number for an id and a text, null for a null id. Keys follow the order of ids, so that the first of a group of copies is the head of its buckets.

    Ids from 0 to ``2 ** 38`` have the hash of the text in the lowest bits: two texts of one id are taken for one with probability 3e-8. Others have a negative hash of both.
    """
    h = F.xxhash64(text)
    near = F.shiftleft(doc_id, TEXT_BITS).bitwiseOR(h.bitwiseAND((1 << TEXT_BITS) - 1))
    far = -1 - F.xxhash64(doc_id, text).bitwiseAND((1 << 63) - 1)
    return F.when(doc_id.between(0, (1 << (63 - TEXT_BITS)) - 1), near).when(doc_id.isNotNull(), far)


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tensor: Tensor | None = None) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id.

    A document is an id with a text (``document_key``): one id with unlike texts is several documents, of which each stays that is like no other. Of rows equal in both one stays,
    and rows with a null id stay. Only rows whose bit is set among the documents to drop are moved to be compared with them. Columns of any name stay as they are.
    """
    own = document_key(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    named = docs.select(own.alias("key"), F.col("doc_id").cast("bigint").alias("id"), "text")
    groups = cut(near_duplicates(named.select(F.col("key").alias("doc_id"), "text"), width, percent, tensor).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")))
    # Groups are by hash; of each the member with the smallest id stays.
    members = groups.where("key <> component").distinct()
    members = members.unionByName(members.select(F.col("component").alias("key"), "component").distinct())
    members = cut(members.join(named.where("key is not null").groupBy("key").agg(F.min("id").alias("id")), "key"))
    kept = members.groupBy("component").agg(F.min(F.struct("id", "key")).alias("least")).select(F.col("least.key").alias("key"))
    gone = cut(members.select("key").join(kept, "key", "left_anti"))
    again = groups.where(F.col("key").isNotNull()).groupBy("key").count().where("count > 1").select("key")
    bits = bit_table(gone.unionByName(again).withColumnRenamed("key", "id"))
    rows = docs.select(own.alias("key"), F.struct("*").alias("row")).withColumn("bit", bit_of("key"))
    rows = rows.withColumn("part", F.bitmap_bucket_number("bit")).join(F.broadcast(bits), "part", "left")
    at = "bitmap_bit_position(bit)"
    rows = rows.withColumn("set", F.expr(f"coalesce(shiftright(cast(conv(hex(substring(bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1, 0) = 1"))
    maybe = rows.where("set and key is not null").select("key", "row").join(gone, "key", "left_anti").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.where("not set or key is null").select("row.*").unionByName(maybe.select("row.*"))
