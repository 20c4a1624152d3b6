"""A linear-chain conditional random field with two labels, in NumPy over many chains at once.

With two labels a chain needs only log-odds: forward, backward and Viterbi
values are one number a position. Chains are walked position by position, all
chains together, longest first, so the active ones are always a prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Chains:
    """Chains laid end to end; ``starts`` has one more entry than there are chains."""

    starts: np.ndarray

    def __post_init__(self) -> None:
        self.lengths = np.diff(self.starts)
        self.order = np.argsort(-self.lengths, kind="stable")
        ranked = self.lengths[self.order]
        self.longest = int(ranked[0]) if len(ranked) else 0
        self.active = np.searchsorted(-ranked, -np.arange(self.longest), side="left")
        self.first = self.starts[:-1][self.order]
        # all positions by step, so that the active ones of a step are neighbours
        self.ends = np.cumsum(self.active)
        self.steps = np.arange(self.ends[-1] if self.longest else 0)
        begin = self.ends - self.active
        self.steps = self.first[self.steps - np.repeat(begin, self.active)] + np.repeat(np.arange(self.longest), self.active)
        self.cuts = list(zip(begin.tolist(), self.ends.tolist(), strict=True))

    def at(self, t: int) -> np.ndarray:
        return self.first[: self.active[t]] + t


@dataclass
class Model:
    """weights: log-odds of label 1 by feature; moves[a, b]: score of label b after a."""

    weights: np.ndarray
    moves: np.ndarray

    def forward(self, e: np.ndarray, c: Chains) -> np.ndarray:
        (oo, ot), (to, tt) = self.moves
        g = e[c.steps]
        for (before, _), (lo, hi) in zip(c.cuts, c.cuts[1:], strict=False):
            x = g[before : before + hi - lo]
            g[lo:hi] += np.logaddexp(x + tt, ot) - np.logaddexp(x + to, oo)
        f = e.copy()
        f[c.steps] = g
        return f

    def backward(self, e: np.ndarray, c: Chains) -> np.ndarray:
        (oo, ot), (to, tt) = self.moves
        g, h = e[c.steps], np.zeros(len(c.steps), e.dtype)
        for (before, _), (lo, hi) in zip(c.cuts[-2::-1], c.cuts[:0:-1], strict=False):
            x = g[lo:hi] + h[lo:hi]
            h[before : before + hi - lo] = np.logaddexp(x + tt, to) - np.logaddexp(x + ot, oo)
        b = np.zeros_like(e)
        b[c.steps] = h
        return b

    def marginals(self, e: np.ndarray, c: Chains) -> np.ndarray:
        return sigmoid(self.forward(e, c) + self.backward(e, c))

    def viterbi(self, e: np.ndarray, c: Chains) -> np.ndarray:
        """The best labelling of every chain, by back pointers."""
        (oo, ot), (to, tt) = self.moves
        f, back0, back1 = e.copy(), np.zeros(len(e), bool), np.zeros(len(e), bool)
        for t in range(1, c.longest):
            at = c.at(t)
            x = f[at - 1]
            back1[at], back0[at] = x + tt > ot, x + to > oo
            f[at] += np.maximum(x + tt, ot) - np.maximum(x + to, oo)
        y = np.zeros(len(e), bool)
        last = c.starts[1:][c.lengths > 0] - 1
        y[last] = f[last] > 0
        for t in range(c.longest - 1, 0, -1):
            at = c.at(t)
            y[at - 1] = np.where(y[at], back1[at], back0[at])
        return y


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


#: Active features that are summed at once, so that sums need no second copy of them all.
PIECE = 1 << 18


def emissions(weights: np.ndarray, token: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    return summed(token, n, lambda at: weights[feature[at]])


def summed(keys: np.ndarray, n: int, values: Callable[[slice], np.ndarray]) -> np.ndarray:
    """Sums of ``values`` by key, added in their order, a piece at a time."""
    out = np.zeros(n)
    for lo in range(0, len(keys), PIECE):
        at = slice(lo, lo + PIECE)
        np.add.at(out, keys[at].astype(np.intp), values(at))
    return out


def fit(token: np.ndarray, feature: np.ndarray, labels: np.ndarray, starts: np.ndarray, n_features: int, offset: np.ndarray | None = None, rounds: int = 60, ridge: float = 1e-3, rate: float = 0.3) -> Model:
    """Maximum conditional likelihood by Adam over all chains; (token, feature) lists the active features, ``offset`` are log-odds that tokens have besides."""
    c, n, y = Chains(starts), len(labels), labels.astype(float)
    inner = np.ones(n, bool)
    inner[starts[:-1][c.lengths > 0]] = False
    later = np.flatnonzero(inner)
    pair = (labels[later - 1] * 2 + labels[later]).astype(int)
    seen = np.bincount(pair, minlength=4).reshape(2, 2)
    theta, m, v = np.zeros(n_features + 4), 0.0, 0.0
    scale = max(n, 1)
    for k in range(1, rounds + 1):
        model = Model(theta[:n_features], theta[n_features:].reshape(2, 2))
        e = emissions(model.weights, token, feature, n) + (0.0 if offset is None else offset)
        f, b = model.forward(e, c), model.backward(e, c)
        p = sigmoid(f + b)
        miss = p - y
        grad = summed(feature, n_features, lambda at, miss=miss: miss[token[at]]) / scale + ridge * model.weights / scale
        before, after = f[later - 1], e[later] + b[later]
        score = np.stack([np.full(len(later), model.moves[0, 0]), model.moves[0, 1] + after, before + model.moves[1, 0], before + model.moves[1, 1] + after])
        pairs = np.zeros((2, 2))
        if len(later):  # in place, as these are the largest arrays
            score -= score.max(0)
            np.exp(score, out=score)
            score /= score.sum(0)
            pairs = score.sum(1).reshape(2, 2)
        grad = np.concatenate([grad, ((pairs - seen) / scale + ridge * model.moves / scale).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
    return Model(theta[:n_features], theta[n_features:].reshape(2, 2))
