"""Choice of an index for a target recall: kinds and settings are measured on a sample, and the cheapest that reaches the target is taken.

Costs are counted, not timed, so that choices can be repeated: vector comparisons of a search and of building, and numbers held beside the vectors. Comparisons of approximate
searches are carried to the whole pool in proportion, which favours none: all kinds look at a share of it, but for the graph, whose searches hardly grow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from affinis.operators import graphs, ivf, knn, trees
from affinis.operators.cutting import cut

from .indexes import INDEXES, Index
from .registry import envelope

#: Rows of the sample and of its queries, at most about.
SAMPLE, QUERIES = 5_000, 100


@dataclass
class Trial:
    """One kind and setting: its recall on the sample, and the costs at the size of the pool, in comparisons a query, for building and in numbers a row."""

    config: dict
    recall: float
    compared: float
    build: float
    memory: float

    def cost(self, build_weight: float, memory_weight: float, searches: float) -> float:
        return self.compared + build_weight * self.build / max(1.0, searches) + memory_weight * self.memory


def _drawn(rows: DataFrame, n: int, total: int, salt: str) -> DataFrame:
    share = F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(share < n / max(1, total)).limit(2 * n)


def trials(rows: DataFrame, n: int = 10, target: float = 0.9, sample: int = SAMPLE) -> list[Trial]:
    """Settings of each kind, the cheapest first, until one reaches ``target``; ``exact`` always does."""
    total = rows.count()
    rows = cut(_drawn(rows.select("uid", "vector"), sample, total, "sample"))
    size = rows.count()
    queries = cut(_drawn(rows, QUERIES, size, "queries").select(F.col("uid").alias("qid"), F.col("vector").alias("qvector")))
    exact = cut(knn.nearest_batch(queries, rows, n))
    grown = total / max(1, size)
    width = rows.select(F.size("vector")).first()[0]
    out = [Trial(envelope("exact", INDEXES.known["exact"]), 1.0, float(total), 0.0, 0.0)]

    cells = max(2, int(size**0.5))
    centroids = ivf.fit_cells(rows, cells)
    indexed = cut(ivf.assign(rows, centroids))
    sizes = indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    for probes in _ladder(cells):
        found = ivf.search(indexed, queries, centroids, n, probes)
        asked = ivf.nearest_cells(queries, "qvector", centroids, probes).select("qid", F.explode("cells").alias("cell"))
        compared = asked.join(sizes, "cell").groupBy("qid").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0] or 0
        out.append(Trial(envelope("ivf", INDEXES.known["ivf"], cells=cells, probes=probes), ivf.recall(found, exact), compared * grown + cells, 15.0 * cells * min(total, 50_000) + cells * total, 1.0))
        if out[-1].recall >= target:
            break

    branching, leaf = 8, 32
    tree = trees.kmeans_build(rows, branching, leaf)
    for share in (16, 8, 4, 2, 1):
        budget = max(n, size // share)
        found, compared = trees.kmeans_search(*tree, queries, n, budget, branching)
        compared = compared.agg(F.avg("compared")).first()[0] or 0
        config = envelope("kmeans_tree", INDEXES.known["kmeans_tree"], branching=branching, leaf=leaf, budget=max(n, total // share))
        out.append(Trial(config, ivf.recall(found, exact), compared * grown + branching * tree[2], 4.0 * branching * tree[2] * total, 1.0))
        if out[-1].recall >= target:
            break

    degree = 8
    edges = cut(graphs.build(rows, degree))
    starts = graphs.entries(rows)
    for beam in (20, 40, 80):
        found, compared = graphs.search(rows, edges, starts, queries, n, max(beam, n))
        compared = compared.agg(F.avg("compared")).first()[0] or 0
        config = envelope("graph", INDEXES.known["graph"], degree=degree, beam=beam, metric="euclidean")
        out.append(Trial(config, ivf.recall(found, exact), compared * max(1.0, grown) ** 0.25, 8.0 * (6 * degree) ** 2 / 2 * total, 2.0 * degree / width))
        if out[-1].recall >= target:
            break
    return out


def _ladder(cells: int) -> list[int]:
    return sorted({max(1, round(cells * share)) for share in (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0)})


def autotuned(rows: DataFrame, n: int = 10, target: float = 0.9, build_weight: float = 0.01, memory_weight: float = 0.0, searches: float = 1000.0, sample: int = SAMPLE) -> tuple[Index, list[Trial]]:
    """The built index of the cheapest trial that reaches ``target``, and all trials.

    ``searches`` is over how many queries the cost of building is spread. For Euclidean distance.
    """
    found = trials(rows, n, target, sample)
    best = min((t for t in found if t.recall >= target), key=lambda t: t.cost(build_weight, memory_weight, searches))
    return INDEXES.make(best.config).build(rows), found
