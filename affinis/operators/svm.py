"""Support vector classification: pairwise machines with any of five kernels, sigmoids on held-out margins and coupled class probabilities.

Each pair of classes is a machine, and each machine and each of its held-out folds is a Spark task over the examples of two classes. A task keeps its
examples and a cache of kernel rows of bounded size, never a whole kernel matrix. Rows are scored in Arrow batches against the broadcast support vectors.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Most examples of one machine, and bytes of kernel rows that its task keeps.
MOST_EXAMPLES, CACHE_BYTES = 100_000, 256 << 20
#: Parts of a machine's examples that are held out in turn to fit its sigmoid, and gap at which the dual is solved.
FOLDS, GAP = 5, 1e-3


@dataclass(frozen=True)
class Kernel:
    """``linear``, ``poly``, ``rbf``, ``sigmoid`` or ``intersection``; ``gamma`` 0 means one over the width."""

    name: str = "linear"
    gamma: float = 0.0
    degree: int = 3
    offset: float = 0.0

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The kernel of all rows of ``a`` and ``b``."""
        g = self.gamma or 1.0 / a.shape[1]
        if self.name == "intersection":
            out = np.zeros((len(a), len(b)))
            for x, y in zip(a.T, b.T):
                out += np.minimum(x[:, None], y)
            return out
        if self.name == "rbf":
            return np.exp(-g * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
        dot = a @ b.T
        ways = {"linear": lambda: dot, "poly": lambda: (g * dot + self.offset) ** self.degree, "sigmoid": lambda: np.tanh(g * dot + self.offset)}
        if self.name not in ways:
            raise ValueError(f"no kernel {self.name!r}")
        return ways[self.name]()

    def diagonal(self, a: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *[self.of(x[None], x[None])[0] for x in a]])


class KernelRows:
    """Rows of a kernel matrix, computed when asked for; the latest ones are kept."""

    def __init__(self, kernel: Kernel, x: np.ndarray):
        self.kernel, self.x, self.kept = kernel, x, OrderedDict()
        self.most = max(2, CACHE_BYTES // (8 * max(1, len(x))))

    def __getitem__(self, i: int) -> np.ndarray:
        if i in self.kept:
            self.kept.move_to_end(i)
        else:
            self.kept[i] = self.kernel.of(self.x, self.x[i : i + 1])[:, 0]
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[i]


def solve(kernel: Kernel, x: np.ndarray, y: np.ndarray, bound: np.ndarray, gap: float = GAP, rounds: int | None = None) -> tuple[np.ndarray, float]:
    """Dual weights and bias of ``sign(sum(weights * y * k) + bias)``: steps on the most violating pair until conditions hold within ``gap``."""
    rows, diagonal = KernelRows(kernel, x), kernel.diagonal(x)
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    plus = y > 0
    for _ in range(rounds or max(100_000, 100 * len(y))):
        v = -y * grad
        up = np.where(plus, alpha < bound, alpha > 0)
        low = np.where(plus, alpha > 0, alpha < bound)
        if not up.any() or not low.any():
            break
        i = int(np.where(up, v, -np.inf).argmax())
        if v[i] - np.where(low, v, np.inf).min() < gap:
            break
        k = rows[i]
        # Of the violating partners, the one that gains most by the second-order model.
        bend = np.maximum(diagonal[i] + diagonal - 2 * k, 1e-12)
        lag = np.where(low, v[i] - v, 0.0)
        j = int(np.where(lag > 0, lag * lag / bend, -np.inf).argmax())
        step = (v[i] - v[j]) / bend[j]
        step = min(step, bound[i] - alpha[i] if plus[i] else alpha[i], alpha[j] if plus[j] else bound[j] - alpha[j])
        alpha[i] = min(max(alpha[i] + y[i] * step, 0.0), bound[i])
        alpha[j] = min(max(alpha[j] - y[j] * step, 0.0), bound[j])
        grad += step * y * (k - rows[j])
    v = -y * grad
    free = (alpha > 0) & (alpha < bound)
    if free.any():
        return alpha, float(v[free].mean())
    up, low = np.where(plus, alpha < bound, alpha > 0), np.where(plus, alpha > 0, alpha < bound)
    return alpha, float((v[up].max(initial=-np.inf) + v[low].min(initial=np.inf)) / 2) if up.any() and low.any() else 0.0


def sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of ``1 / (1 + exp(a m + b))``: Newton steps with halving on Platt's smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    loss = lambda beta: float((np.logaddexp(0, x @ beta) - (1 - target) * (x @ beta)).sum())
    beta = np.array([0.0, np.log((n0 + 1) / (n1 + 1))])
    now = loss(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(x @ beta, -500, 500)))
        grad = x.T @ (target - p)
        if np.abs(grad).max() < 1e-5:
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-12 * np.eye(2), grad)
        size = 1.0
        while size > 1e-10 and loss(beta - size * step) > now - 1e-4 * size * float(grad @ step):
            size /= 2
        if size <= 1e-10:
            break
        beta = beta - size * step
        now = loss(beta)
    return float(beta[0]), float(beta[1])


def coupled(pairs: np.ndarray) -> np.ndarray:
    """Class probabilities from ``pairs[r, i, j]``, the probability of class i against j for row r.

    They minimise the sum over pairs of ``(pairs[j, i] p[i] - pairs[i, j] p[j]) ** 2`` with sum 1: one linear system a row.
    """
    n, k = pairs.shape[:2]
    q = -np.swapaxes(pairs, 1, 2) * pairs
    square = pairs**2
    at = np.arange(k)
    q[:, at, at] = square.sum(1) - square[:, at, at]
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k] = q
    system[:, :k, k] = system[:, k, :k] = 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    p = np.maximum(np.linalg.solve(system, right)[:, :k, 0], 0)
    return p / p.sum(1, keepdims=True)


@dataclass
class PairwiseModel:
    """One machine for each pair of ``labels``: support vectors, signed weights, bias and the sigmoid's slope and offset."""

    labels: list[str]
    kernel: Kernel
    machines: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float, float, float]] = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """A column for each pair, positive for its first label."""
        return np.stack([margin_of(self.kernel, s, w)(x) + b for s, w, b, _, _ in (self.machines[p] for p in sorted(self.machines))], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        k = len(self.labels)
        pairs = np.full((len(x), k, k), 0.5)
        for (i, j), m in zip(sorted(self.machines), self.margins(x).T):
            _, _, _, a, b = self.machines[i, j]
            p = np.clip(1 / (1 + np.exp(np.clip(a * m + b, -500, 500))), 1e-7, 1 - 1e-7)
            pairs[:, i, j], pairs[:, j, i] = p, 1 - p
        return coupled(pairs)


def margin_of(kernel: Kernel, support: np.ndarray, weights: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sum of weighted kernels of a batch of rows with the support vectors.

    The intersection kernel needs no pairs: in each dimension the support values are sorted once, with sums of weights and of weighted values up to each, and a row looks up its place.
    """
    if kernel.name != "intersection" or not len(support):
        return lambda x: kernel.of(x, support) @ weights
    order = np.argsort(support, 0, kind="stable")
    values = np.take_along_axis(support, order, 0)
    w = weights[order]
    zero = np.zeros((1, support.shape[1]))
    below = np.concatenate([zero, np.cumsum(w * values, 0)])
    above = w.sum(0) - np.concatenate([zero, np.cumsum(w, 0)])

    def run(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for d in range(x.shape[1]):
            at = np.searchsorted(values[:, d], x[:, d], side="right")
            out += below[at, d] + x[:, d] * above[at, d]
        return out

    return run


def _machine(kernel: Kernel, c: float, weights: tuple[float, float], x: np.ndarray, y: np.ndarray):
    alpha, bias = solve(kernel, x, y, np.where(y > 0, c * weights[0], c * weights[1]))
    used = alpha > 0
    return x[used], (alpha * y)[used], bias


def fit(examples: DataFrame, kernel: Kernel | None = None, c: float = 1.0, balanced: bool = False, seed: int = 0) -> PairwiseModel:
    """Machines for all pairs of labels of ``examples (vector, label)``; needs two labels.

    Sigmoids are fitted on margins of held-out parts, dealt by a hash of the vector and its label; where a part leaves one class alone, its margins are 1 or -1 by the class, and 0 without any. With ``balanced``, a class
    weighs by the geometric mean of all sizes over its own. Raises beyond ``MOST_EXAMPLES`` in a pair.
    """
    kernel = kernel or Kernel()
    named = examples.where(F.col("vector").isNotNull() & F.col("label").isNotNull()).select(F.col("label").cast("string").alias("label"), "vector").withColumn("fold", F.pmod(F.xxhash64("vector", "label", F.lit(seed)), F.lit(FOLDS)).cast("int"))
    sizes = {r["label"]: r["count"] for r in named.groupBy("label").count().collect()}
    labels = sorted(sizes)
    if len(labels) < 2:
        raise ValueError("training needs at least two labels")
    if sum(sorted(sizes.values())[-2:]) > MOST_EXAMPLES:
        raise ValueError(f"a pair has more than {MOST_EXAMPLES} examples")
    mean = float(np.exp(np.mean(np.log(list(sizes.values())))))
    weigh = {x: mean / sizes[x] if balanced else 1.0 for x in labels}
    number = {x: i for i, x in enumerate(labels)}
    # A row for each machine that an example is in, once for the machine and once for each fold.
    others = [F.struct(F.least(F.lit(i), F.col("own")).alias("i"), F.greatest(F.lit(i), F.col("own")).alias("j")) for i in range(len(labels))]
    own = F.element_at(F.create_map(*[x for label, i in number.items() for x in (F.lit(label), F.lit(i))]), F.col("label"))
    dealt = named.withColumn("own", own).withColumn("pair", F.explode(F.array(*others))).where("pair.i <> pair.j")
    dealt = dealt.select("pair.i", "pair.j", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1))).alias("held"), "own", "fold", "vector")
    schema = "i int, j int, held int, support binary, weights binary, bias double, margins binary, signs binary"

    def train(key: tuple, table: pa.Table) -> pa.Table:
        i, j, held = (k.as_py() for k in key)
        # A fixed order makes results repeatable.
        x = np.array(table.column("vector").to_pylist(), np.float64)
        y = np.where(table.column("own").to_numpy() == i, 1.0, -1.0)
        fold = table.column("fold").to_numpy()
        order = np.lexsort([*x.T[::-1], y])
        x, y, fold = x[order], y[order], fold[order]
        weights = weigh[labels[i]], weigh[labels[j]]
        if held < 0:
            s, w, b = _machine(kernel, c, weights, x, y)
            cells = s.tobytes(), w.tobytes(), b, b"", b""
        else:
            out, kept = fold == held, fold != held
            if not out.any():
                m = np.empty(0)
            elif len(np.unique(y[kept])) < 2:
                m = np.full(int(out.sum()), y[kept][0] if kept.any() else 0.0)
            else:
                s, w, b = _machine(kernel, c, weights, x[kept], y[kept])
                m = margin_of(kernel, s, w)(x[out]) + b
            cells = b"", b"", 0.0, m.tobytes(), y[out].tobytes()
        values = (i, j, held, *cells)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary())
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=["i", "j", "held", "support", "weights", "bias", "margins", "signs"])

    found: dict[tuple[int, int], list] = {}
    for row in dealt.groupBy("i", "j", "held").applyInArrow(train, schema).collect():
        found.setdefault((row["i"], row["j"]), []).append(row)
    model = PairwiseModel(labels, kernel)
    for pair, parts in found.items():
        whole = next(r for r in parts if r["held"] < 0)
        parts = sorted((r for r in parts if r["held"] >= 0), key=lambda r: r["held"])
        w = np.frombuffer(whole["weights"])
        m, y = (np.concatenate([np.frombuffer(r[name]) for r in parts]) for name in ("margins", "signs"))
        model.machines[pair] = np.frombuffer(whole["support"]).reshape(len(w), -1), w, whole["bias"], *sigmoid(m, y)
    return model


def classify(rows: DataFrame, model: PairwiseModel, key: str = "uid") -> DataFrame:
    """``(key, scores)``: the probability of each label for each row ``(key, vector)``; null vectors have null scores."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    plain = rows.select(key, "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out: list = [None] * batch.num_rows
            at = [i for i, v in enumerate(batch.column(1)) if v.is_valid]
            if at:
                p = model.probabilities(np.array([batch.column(1)[i].as_py() for i in at], np.float64))
                for i, row in zip(at, p.tolist()):
                    out[i] = list(zip(model.labels, row))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.map_(pa.string(), pa.float64()))], [key, "scores"])

    return plain.mapInArrow(run, f"{key} {dict(plain.dtypes)[key]}, scores map<string,double>")
