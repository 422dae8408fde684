"""Sharding by balanced label propagation.

Documents with equal texts are linked. They start in a shard chosen by hash and move, round by round, to the shard
that holds most of their neighbours, under quotas that keep the linked documents of a shard within its size. Documents
without links fill what is left, so that in the end the row counts of all shards differ by one at most (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .runtime import cut

#: Rows for which one more range of a shard's order is opened.
RANGE_ROWS = 20_000
#: Equal rows that are numbered together.
BENCH = 1000


def _unit(*columns: str | Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _literal(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def propagate(groups: DataFrame, targets: list[int], rounds: int) -> DataFrame:
    """``(text_key, shard, n)`` after moving the members of each group towards one shard.

    ``groups`` has the number ``n`` of a group's members in each ``shard``. A round finds each group's fullest shard
    that has room, asks for the moves there, and grants of the moves into a shard the share that its quota allows.
    A member moves only from a shard that holds no more of the group. One group may exceed a shard and then fills several.
    """
    shards = len(targets)
    state = groups
    for step in range(rounds):
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, targets[s] - held.get(s, 0)) for s in range(shards)]
        open_ = _literal([r > 0 for r in room], "boolean")
        best = state.where(F.element_at(open_, F.col("shard") + 1)).groupBy("text_key").agg(F.max(F.struct("n", F.pmod(F.xxhash64("text_key", "shard"), F.lit(997)).alias("t"), F.col("shard").alias("to"))).alias("best"))
        # Of shards that hold as many, open ones give to the best of them, and full ones give way to it.
        asked = state.join(best, "text_key").where((F.col("shard") != F.col("best.to")) & (F.col("n") <= F.col("best.n"))).select("text_key", "shard", "n", F.col("best.to").alias("to"))
        asked = cut(asked)
        wish = {r["to"]: r["n"] for r in asked.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        if not any(room[s] for s in wish):
            break
        share = _literal([min(1.0, room[s] / wish[s]) if s in wish else 0.0 for s in range(shards)], "double")
        rate = F.element_at(share, F.col("to") + 1)
        # A group that has room moves whole or not at all, in proportion; one that is larger than the room moves in part.
        space = F.element_at(_literal(room, "bigint"), F.col("to") + 1)
        wishes = asked.groupBy("text_key").agg(F.sum("n").alias("wish"))
        part = F.col("n") * rate
        some = F.floor(part) + (_unit("text_key", "shard", F.lit(step)) < part - F.floor(part)).cast("bigint")
        whole = F.when(_unit("text_key", F.lit(step)) < rate, F.col("n")).otherwise(F.lit(0).cast("bigint"))
        granted = asked.join(wishes, "text_key").withColumn("m", F.when(F.col("wish") > space, some).otherwise(whole).cast("bigint"))
        moved = granted.select("text_key", "shard", (-F.col("m")).alias("n")).unionByName(granted.select("text_key", F.col("to").alias("shard"), F.col("m").alias("n")))
        state = cut(state.unionByName(moved).groupBy("text_key", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return state


def shard(docs: DataFrame, shards: int = 16, rounds: int = 24) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row for each row of ``docs``.

    Law ``rows``: the counts of the shards differ by one at most. ``size`` is the UTF-8 length of the text plus 1 (null:
    1), ``text_crc32`` its unsigned CRC-32 (of the empty text for null), ``slot`` counts from 0 without gaps in each
    shard, ``grown_shard`` is null for this law. Linked are rows with equal texts, null or empty ones too.

    Null ids and repeated rows are rows like others. An empty table gives an empty result. Only
    counts by shard and range come to the driver, ``shards`` times the number of ranges.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("text_key"))
    # A seat tells rows of one id and text apart, so that they are dealt to many places. Seats are numbers up to the count of such rows, so where rows lie in files changes nothing.
    alike = rows.groupBy("doc_id", "size", "text_crc32", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    bench = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / BENCH)))
    alike = alike.withColumn("bench", bench).repartition("doc_id", "text_key", "bench")
    seats = F.explode(F.sequence(F.col("bench") * BENCH, F.least(F.col("bench") * BENCH + BENCH, F.col("copies")) - 1))
    rows = cut(alike.withColumn("seat", seats).drop("copies", "bench"))
    rows = rows.withColumn("start", F.pmod(F.xxhash64("doc_id", "seat", F.lit("start")), F.lit(shards)).cast("int"))
    total = rows.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    cells = rows.groupBy("text_key", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    several = cells.groupBy("text_key").agg(F.sum("n").alias("all")).where("all > 1")
    state = propagate(cut(cells.join(several.select("text_key"), "text_key", "left_semi")), targets, rounds)

    # A group's members take the shards of their group by their rank in a hash order. Ranks are only needed where a group has
    # several shards; they come from counts of parts of that order, and the rank within a part.
    fine = W.partitionBy("text_key").orderBy(F.col("n").desc(), "shard")
    spans = state.select("text_key", "shard", "n", F.sum("n").over(fine.rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    plan = spans.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("plan"), F.max("upto").alias("all"))
    placed = rows.withColumn("place", _unit("doc_id", "text_key", "seat", F.lit("place"))).join(plan, "text_key", "left")
    placed = placed.withColumn("single", F.col("plan").isNull().cast("int")).withColumn("several", F.coalesce(F.size("plan") > 1, F.lit(False)))
    columns = ["doc_id", "size", "text_crc32", "single", "place", "seat"]
    simple = placed.where("not several").select(*columns, F.coalesce(F.col("plan")[0]["shard"], F.col("start")).alias("shard"))
    split = placed.where("several").withColumn("part", F.floor(F.col("place") * F.ceil(F.col("all") / RANGE_ROWS)))
    parts = split.groupBy("text_key", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("text_key", "part", F.coalesce(F.sum("n").over(W.partitionBy("text_key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("text_key", "part").orderBy("place", "seat")) - 1
    split = split.join(parts, ["text_key", "part"]).withColumn("rank", F.col("before") + rank)
    split = split.select(*columns, F.filter("plan", lambda p: p["upto"] > F.col("rank"))[0]["shard"].alias("shard"))
    chosen = simple.unionByName(split)
    ranges = max(1, total // shards // RANGE_ROWS)
    # Rows without links come last in a shard's order: they are the first to make room.
    chosen = cut(chosen.select("doc_id", "size", "text_crc32", "shard", (F.col("single") * ranges + F.floor(F.col("place") * ranges)).cast("int").alias("range"), "place", "seat"))

    counts = {(r["shard"], r["range"]): r["count"] for r in chosen.groupBy("shard", "range").count().collect()}
    first, held = {}, []
    for s in range(shards):
        n = 0
        for r in range(2 * ranges):
            first[s * 2 * ranges + r] = n
            n += counts.get((s, r), 0)
        held.append(n)
    over, free, spare = [], [], 0
    for s in range(shards):
        over.append(spare)
        spare += max(0, held[s] - targets[s])
    for s in range(shards):
        free += [(s, held[s], targets[s] - held[s])] if held[s] < targets[s] else []
    own = W.partitionBy("shard", "range").orderBy("place", "seat")
    starts = chosen.sparkSession.createDataFrame([(k // (2 * ranges), k % (2 * ranges), n) for k, n in first.items()], "shard int, range int, first bigint")
    ranked = chosen.withColumn("rank", F.row_number().over(own) - 1).join(F.broadcast(starts), ["shard", "range"]).withColumn("slot", F.col("first") + F.col("rank"))
    # What is over a shard's count takes the free slots of others, in order.
    target, before = _literal(targets, "bigint"), _literal(over, "bigint")
    excess = F.col("slot") - F.element_at(target, F.col("shard") + 1)
    ranked = ranked.withColumn("spare", F.when(excess >= 0, excess + F.element_at(before, F.col("shard") + 1)))
    to, slot, seen = F.lit(None).cast("int"), F.lit(None).cast("bigint"), 0
    for s, from_, n in free:
        inside = (F.col("spare") >= seen) & (F.col("spare") < seen + n)
        to, slot = F.when(inside, F.lit(s)).otherwise(to), F.when(inside, F.col("spare") - seen + from_).otherwise(slot)
        seen += n
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce(to, F.col("shard")).cast("int").alias("shard"), F.coalesce(slot, F.col("slot")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
