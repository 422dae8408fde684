"""Aggregates over labels and scores: confusion, curves, pooling, histograms, folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from affinis.functions import numbers

from . import knn


def argmax_label(scores: DataFrame) -> DataFrame:
    """``(uid, label, score)`` of ``(uid, scores MAP)``: the greatest score, of equal ones the first label by name."""
    best = F.get(F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("label")))), F.lit(0))
    return scores.select("uid", best["label"].alias("label"), (-best["s"]).alias("score"))


def confusion(pairs: DataFrame) -> DataFrame:
    """``(truth, predicted, n)`` with a row for each pair of the labels that occur on either side."""
    labels = pairs.select(F.col("truth").alias("label")).union(pairs.select("predicted")).distinct()
    cells = labels.select(F.col("label").alias("truth")).crossJoin(labels.select(F.col("label").alias("predicted")))  # labels, not rows
    counts = pairs.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return cells.join(counts, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def normalized(cells: DataFrame, digits: int = 6) -> DataFrame:
    """Confusion cells over the sum of their row; 0 for an empty row."""
    total = F.sum("n").over(W.partitionBy("truth"))
    return cells.select("truth", "predicted", F.round(F.when(total > 0, F.col("n") / total).otherwise(0.0), digits).alias("share"))


def confusion_uids(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "predicted").agg(F.sort_array(F.collect_list("uid")).alias("uids"))


#: Parts of a numeric order, between quantiles.
PARTS = 200


def quantile_parts(rows: DataFrame, by: list[str], column: str, parts: int = PARTS) -> DataFrame:
    """``rows`` with ``_at``, the number of the part of ``column``'s order, between approximate quantiles within ``by``; equal values share a part."""
    bounds = rows.groupBy(*by).agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 10_000).alias("_bounds"))
    joined = rows.join(bounds, by) if by else rows.crossJoin(F.broadcast(bounds))  # without ``by`` one row
    return joined.withColumn("_at", F.size(F.filter("_bounds", lambda b: b < F.col(column)))).drop("_bounds")


def cumulative(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(score, p, n, tp, fp, all_p, all_n)`` by distinct score, descending, of ``(score, truth 0/1)`` rows.

    Sums by part of the scores' order go before running sums within a part, so that many distinct scores are not in one task.
    """
    by = by or []
    steps = scored.groupBy(*by, "score").agg(F.sum("truth").cast("bigint").alias("p"), F.sum(1 - F.col("truth")).cast("bigint").alias("n"))
    steps = quantile_parts(steps, by, "score")
    totals = steps.groupBy(*by, "_at").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = whole.orderBy(F.col("_at").desc()).rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select(*by, "_at", earlier("_p").alias("_tp"), earlier("_n").alias("_fp"), F.sum("_p").over(whole).alias("all_p"), F.sum("_n").over(whole).alias("all_n"))
    run = W.partitionBy(*by, "_at").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    return steps.join(totals, [*by, "_at"]).select(*by, "score", "p", "n", (F.col("_tp") + F.sum("p").over(run)).alias("tp"), (F.col("_fp") + F.sum("n").over(run)).alias("fp"), "all_p", "all_n")


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def roc_curve(scored: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    return cumulative(scored, by).select(*(by or []), "score", F.round(_share("fp", "all_n"), digits).alias("fpr"), F.round(_share("tp", "all_p"), digits).alias("tpr"))


def roc_auc(scored: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Area under the curve; equal scores count half. Null if only one kind occurs."""
    area = F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.max("all_p") * F.max("all_n"))
    return cumulative(scored, by).groupBy(*(by or [])).agg(F.round(area, digits).alias("auc"))


def pr_curve(scored: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    c = cumulative(scored, by)
    return c.select(*(by or []), "score", F.round(_share("tp", "all_p"), digits).alias("recall"), F.round(F.col("tp") / (F.col("tp") + F.col("fp")), digits).alias("precision"))


def pr_auc(scored: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Area under the precision-recall curve by trapezoids, from recall 0 at precision 1."""
    # What stands one score above follows from the sums without this score's own.
    c = cumulative(scored, by).withColumn("r", _share("tp", "all_p")).withColumn("q", F.col("tp") / (F.col("tp") + F.col("fp")))
    tp, all_ = F.col("tp") - F.col("p"), F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    c = c.withColumn("r0", F.when(F.col("all_p") > 0, tp / F.col("all_p")).otherwise(0.0)).withColumn("q0", F.when(all_ > 0, tp / all_).otherwise(1.0))
    return c.groupBy(*(by or [])).agg(F.round(F.sum((F.col("r") - F.col("r0")) * (F.col("q") + F.col("q0")) / 2), digits).alias("auc"))


def one_vs_rest(scores: DataFrame) -> DataFrame:
    """``(label, score, truth)`` for each label of ``(truth_label, scores MAP)``."""
    return scores.select("truth_label", F.explode("scores").alias("label", "score")).select("label", "score", (F.col("label") == F.col("truth_label")).cast("int").alias("truth"))


def wilson(counts: DataFrame, digits: int = 6) -> DataFrame:
    low, high = numbers.wilson(F.col("successes"), F.col("trials"))
    return counts.withColumn("low", F.round(low, digits)).withColumn("high", F.round(high, digits))


def pooled(members: DataFrame, middle: str, top: str, score: str = "score", default: float | None = None, parents: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """Greatest and mean score by ``top``, of each ``middle``'s greatest and mean.

    With ``parents``, those without any member get ``default``.
    """
    mid = members.groupBy(top, middle).agg(F.max(score).alias("hi"), F.avg(score).alias("mean"))
    out = mid.groupBy(top).agg(F.max("hi").alias("max_score"), F.round(F.avg("mean"), digits).alias("avg_score"))
    if parents is None:
        return out
    out = parents.select(top).distinct().join(out, top, "left")
    return out if default is None else out.fillna(default, ["max_score", "avg_score"])


def pooled_available(members: DataFrame, available: DataFrame, parent: str, member: str = "uid", score: str = "score") -> DataFrame:
    """Greatest score over the members that have a descriptor; fails if there is none at all."""
    out = members.join(available.select(member), member, "left_semi").groupBy(parent).agg(F.max(score).alias("max_score"))
    if out.isEmpty():
        raise ValueError("no member has a descriptor")
    return out


def score_histogram(scores: DataFrame, by: str, bins: int = 20, digits: int = 6) -> DataFrame:
    """Share of each of ``bins`` equal parts of [0, 1], the last one closed, among a group's scores; empty parts too."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = scores.groupBy(by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cells = scores.select(by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = cells.join(counts, [by, "bin"], "left").fillna(0, ["n"])
    return full.select(by, "bin", F.round(F.col("n") / F.sum("n").over(W.partitionBy(by)), digits).alias("share"))


def bag_of_words(quantised: DataFrame, bins: int, digits: int = 6) -> DataFrame:
    """``(item, histogram)`` of ``(item, bin)`` rows: counts over all bins, with sum 1."""
    counts = quantised.groupBy("item", "bin").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("all"))
    return maps.select("item", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.round(F.coalesce(F.element_at("m", b), F.lit(0)) / F.col("all"), digits)).alias("histogram"))


def pyramid(quantised: DataFrame, digits: int = 6) -> DataFrame:
    """``(item, region, bin, share)`` of ``(item, x, y, bin)``: the whole (0), quadrants (1-4) and horizontal thirds (5-7)."""
    sizes = quantised.groupBy("item").agg(F.ceil(F.max("x") / 2).alias("mx"), F.ceil(F.max("y") / 2).alias("my"), F.ceil(F.max("y") / 3).alias("third"))
    placed = quantised.join(sizes, "item")
    quadrant = F.lit(1) + (F.col("x") >= F.col("mx")).cast("int") + 2 * (F.col("y") >= F.col("my")).cast("int")
    band = F.lit(5) + F.least(F.floor(F.col("y") / F.greatest(F.col("third"), F.lit(1))), F.lit(2)).cast("int")
    rows = placed.select("item", "bin", F.explode(F.array(F.lit(0), quadrant, band)).alias("region")).groupBy("item", "region", "bin").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("item", "region", "bin", F.round(F.col("n") / F.sum("n").over(W.partitionBy("item", "region")), digits).alias("share"))


def class_weights(labels: DataFrame, digits: int = 6) -> DataFrame:
    """Geometric mean of the class sizes over each class's size."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    mean = F.exp(F.avg(F.log("n")).over(W.partitionBy(F.lit(0))))  # one row per class
    return n.select("label", "n", F.round(mean / F.col("n"), digits).alias("weight"))


def positive_weight(labels: DataFrame) -> DataFrame:
    """``max(1, negatives / positives)`` of 0/1 labels."""
    return labels.agg(F.round(F.greatest(F.lit(1.0), F.try_divide(F.sum(1 - F.col("label")), F.sum("label"))), 6).alias("weight"))


def split_counts(rows: DataFrame) -> DataFrame:
    n = rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n"))
    return n.select("label", "part", "n", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy("label")), 6).alias("percent"))


def ranked(rows: DataFrame, by: list[str], order: list[Column], part: Column) -> DataFrame:
    """``rows`` with ``rank`` from 1 in ``order`` within ``by``, and ``all``, the number of rows there.

    ``part`` is a number that grows with the order and takes few values: a small table of counts by part is summed up, and only the rows of one part
    are ordered together.
    """
    placed = rows.withColumn("_part", part)
    counts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "_part", before.alias("_before"), F.sum("_n").over(whole).alias("all"))
    rank = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order)) + F.col("_before")
    return placed.join(starts, [*by, "_part"]).withColumn("rank", rank).drop("_part", "_before")


def _hashed(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    order = knn.hash_order(seed=seed)
    return ranked(rows, by, [order, F.col("uid")], F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))


def stratified_folds(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``fold`` from 0 to ``k - 1``, dealt round within each label in a seeded order."""
    return _hashed(rows, ["label"], seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).select(*rows.columns, "fold")


def stratified_split(rows: DataFrame, test_share: float, seed: int = 0) -> DataFrame:
    """``part`` train or test, with the rounded share of each label in test."""
    return _hashed(rows, ["label"], seed).withColumn("part", F.when(F.col("rank") <= F.round(F.col("all") * test_share), "test").otherwise("train")).select(*rows.columns, "part")


def size_ranked_split(members: DataFrame, group: str, parts: tuple[str, ...] = ("train1", "train2", "train3", "test")) -> DataFrame:
    """Groups by size and numeric id, descending, are dealt round to ``parts``; members follow their group."""
    sizes = quantile_parts(members.groupBy(group).agg(F.count(F.lit(1)).alias("size")), [], group)
    order = ranked(sizes, [], [F.col(group).desc()], F.struct(-F.col("size"), -F.col("_at")))
    part = F.element_at(F.array(*[F.lit(p) for p in parts]), ((F.col("rank") - 1) % len(parts) + 1).cast("int"))
    return members.join(order.select(group, part.alias("part")), group)


def cross_validated(rows: DataFrame, fit, k: int = 5, seed: int = 0) -> DataFrame:
    """``(uid, truth_label, scores, fold)``: each row of ``(uid, vector, label)`` is scored by a model fitted on the other folds.

    ``fit`` gives a model with ``scores(vector)`` for ``(vector, label)`` rows.
    """
    folds = stratified_folds(rows.select("uid", "vector", "label"), k, seed)
    out = None
    for fold in range(k):
        model = fit(folds.where(F.col("fold") != fold).select("vector", "label"))
        one = folds.where(F.col("fold") == fold).select("uid", F.col("label").cast("string").alias("truth_label"), model.scores(F.col("vector")).alias("scores"), "fold")
        out = one if out is None else out.unionByName(one)
    return out
