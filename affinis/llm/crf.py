"""Linear-chain conditional random field on NumPy: training, marginals and Viterbi decoding.

Sequences lie one after the other in flat arrays; each step of a recursion handles that position of all
sequences at once. Recursions run over whole sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pairs of neighbouring tokens whose probabilities are held at once in training.
_PAIRS = 1 << 14


@dataclass
class Chain:
    """``weights[feature, label]``, ``moves[from, to]`` and ``first[label]``, as log potentials."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    @property
    def labels(self) -> int:
        return self.weights.shape[1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _steps(lengths: np.ndarray):
    """Starts of the sequences, longest first, and how many reach each position."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return starts[order], lengths[order], active


def forward_backward(chain: Chain, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log messages of each token, and each sequence's log partition by token."""
    starts, sizes, active = _steps(lengths)
    alpha, beta, total = np.empty_like(emissions), np.zeros_like(emissions), np.empty(len(emissions))
    if not len(starts):
        return alpha, beta, total
    alpha[starts] = emissions[starts] + chain.first
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        alpha[at] = emissions[at] + _log_sum(alpha[at - 1][:, :, None] + chain.moves, 1)
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        beta[at] = _log_sum(chain.moves + (emissions[at + 1] + beta[at + 1])[:, None, :], 2)
    total[np.repeat(starts, sizes) + _within(sizes)] = np.repeat(_log_sum(alpha[starts + sizes - 1], 1), sizes)
    return alpha, beta, total


def _within(sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def marginals(chain: Chain, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of each label at each token, given the whole sequence."""
    lengths = lengths[lengths > 0]
    if chain.labels == 2 and np.ptp(chain.moves) < 100:
        second = _odds_marginals(chain, emissions, lengths)
        return np.stack([1 - second, second], 1)
    alpha, beta, total = forward_backward(chain, emissions, lengths)
    return np.exp(np.minimum(alpha + beta - total[:, None], 0))


def _odds_marginals(chain: Chain, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of the second of two labels: both recursions on the labels' odds, which each step keeps within bounds that the moves set."""
    starts, sizes, active = _steps(lengths)
    own = np.exp(np.clip(emissions[:, 1] - emissions[:, 0], -300, 300))
    odds = np.empty(len(emissions))
    if not len(starts):
        return odds
    (stay, enter), (leave, go) = np.exp(chain.moves - chain.moves.max()).tolist()
    now = own[starts] * np.exp(np.clip(chain.first[1] - chain.first[0], -300, 300))
    odds[starts] = now
    for t in range(1, len(active)):
        at, now = starts[: active[t]] + t, now[: active[t]]
        now = own[at] * (enter + go * now) / (stay + leave * now)
        odds[at] = now
    now = np.ones(active[-1])
    for t in range(len(active) - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        # Sequences that end at the next position begin with odds of 1.
        now = np.concatenate([now, np.ones(active[t + 1] - len(now))]) * own[at + 1]
        now = (leave + go * now) / (stay + enter * now)
        odds[at] *= now
    return odds / (1 + odds)


def viterbi(chain: Chain, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels of each sequence's best path; of equal labels the first."""
    lengths = lengths[lengths > 0]
    starts, sizes, active = _steps(lengths)
    best, back = np.empty_like(emissions), np.zeros(emissions.shape, np.int8)
    out = np.zeros(len(emissions), np.int8)
    if not len(starts):
        return out
    best[starts] = emissions[starts] + chain.first
    for t in range(1, len(active)):
        at = starts[: active[t]] + t
        scores = best[at - 1][:, :, None] + chain.moves
        back[at] = scores.argmax(1)
        best[at] = emissions[at] + scores.max(1)
    out[starts + sizes - 1] = best[starts + sizes - 1].argmax(1)
    for t in range(len(active) - 1, 0, -1):
        at = starts[: active[t]] + t
        out[at - 1] = back[at, out[at]]
    return out


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, size: int, n_labels: int, rounds: int = 25, rate: float = 0.5, decay: float = 3e-6, weights: np.ndarray | None = None) -> Chain:
    """Maximum likelihood by AdaGrad over all sequences at once.

    ``features[token, k]`` are indices below ``size``, ``labels`` the tokens' labels, ``weights`` how much a token's
    sequence counts, the same for all its tokens.
    """
    chain = Chain(np.zeros((size, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    if not len(labels):
        return chain
    lengths = lengths[lengths > 0]
    heads = np.zeros(len(labels), bool)
    heads[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    later = np.flatnonzero(~heads)
    weigh = np.ones(len(labels)) if weights is None else weights
    gold_moves = np.zeros((n_labels, n_labels))
    np.add.at(gold_moves, (labels[later - 1], labels[later]), weigh[later])
    # Only the weights of features that occur ever move; one column of features is looked up at a time, so that no table of all tokens' features is made.
    seen = np.zeros(size, bool)
    for column in features.T:
        seen[column] = True
    used = np.flatnonzero(seen)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    columns = [place[column] for column in features.T]
    small = Chain(np.zeros((len(used), n_labels)), chain.moves, chain.first)
    sums = [np.full_like(p, 1e-8) for p in (small.weights, small.moves, small.first)]
    for _ in range(rounds):
        emissions = np.zeros((len(labels), n_labels))
        for column in columns:
            emissions += small.weights[column]
        alpha, beta, total = forward_backward(small, emissions, lengths)
        pair = -gold_moves
        for i in range(0, len(later), _PAIRS):
            at = later[i : i + _PAIRS]
            pairs = np.exp(alpha[at - 1][:, :, None] + small.moves + (emissions[at] + beta[at])[:, None, :] - total[at][:, None, None])
            pair = pair + np.einsum("n,nij->ij", weigh[at], pairs)
        del emissions
        alpha += beta
        alpha -= total[:, None]
        del beta, total
        gap = np.exp(np.minimum(alpha, 0, out=alpha), out=alpha)
        gap[np.arange(len(labels)), labels] -= 1
        gap *= weigh[:, None]
        slope = np.zeros_like(small.weights)
        for j in range(n_labels):
            for column in columns:
                slope[:, j] += np.bincount(column, weights=gap[:, j], minlength=len(used))
        for value, g, s in zip((small.weights, small.moves, small.first), (slope, pair, gap[heads].sum(0)), sums, strict=True):
            g = g + decay * weigh.sum() * value
            s += g**2
            value -= rate * g / np.sqrt(s)
    chain.weights[used] = small.weights
    return chain
