"""A linear-chain conditional random field with two states, for use inside tasks.

The score of a labelling is the sum of the emission scores of its positions in state 1
(state 0 scores nothing), of a start score and of four transition scores.  Sequences are
handled side by side, ordered by length, one position at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    #: weight of each feature when its position is in state 1
    weights: dict[str, float] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def _groups(self, sizes: np.ndarray, most: int = 256):
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        for at in range(0, len(order), most):
            yield order[at : at + most]

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds of state 1 at each position of sequences laid end to end, by forward-backward."""
        starts = np.cumsum(sizes) - sizes
        ahead, back = np.zeros(len(emissions)), np.zeros(len(emissions))
        t = np.exp(self.trans)
        for group in self._groups(sizes):
            size, first = sizes[group], starts[group]
            live = len(group)
            odds = None
            for k in range(size[0]):  # sizes fall, so the sequences still running come first
                live = np.searchsorted(-size, -k, side="left") if k else live
                at = first[:live] + k
                if odds is None:
                    odds = self.start[1] - self.start[0] + emissions[at]
                else:
                    x = np.exp(np.clip(odds[:live], -700, 700))
                    odds = emissions[at] + np.log((t[0, 1] + x * t[1, 1]) / (t[0, 0] + x * t[1, 0]))
                ahead[at] = odds
            after = np.zeros(len(group))
            for k in range(size[0] - 2, -1, -1):
                live = np.searchsorted(-size, -(k + 1), side="left")
                at = first[:live] + k
                x = np.exp(np.clip(after[:live] + emissions[at + 1], -700, 700))
                after[:live] = np.log((t[1, 0] + x * t[1, 1]) / (t[0, 0] + x * t[0, 1]))
                back[at] = after[:live]
        return ahead + back

    def viterbi(self, emissions) -> list[int]:
        """The best labelling of one sequence."""
        if not len(emissions):
            return []
        (t00, t01), (t10, t11) = self.trans.tolist()
        zero, one = float(self.start[0]), float(self.start[1]) + emissions[0]
        came = []
        for e in emissions[1:]:
            stay, leave, enter, keep = zero + t00, one + t10, zero + t01, one + t11
            came.append((int(leave > stay), int(keep >= enter)))
            zero, one = max(stay, leave), max(enter, keep) + e
        path = [int(one > zero)]
        for step in reversed(came):
            path.append(step[path[-1]])
        return path[::-1]

    def emissions(self, features: list[list[str]]) -> np.ndarray:
        get = self.weights.get
        return np.array([sum(get(f, 0.0) for f in fs) for fs in features])


def fit(sequences: list[list[list[str]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.4, penalty: float = 0.02) -> Chain:
    """Train by full-batch gradient ascent (Adam) on the penalised conditional log likelihood."""
    names: dict[str, int] = {}
    position, feature, at = [], [], 0
    for s in sequences:
        for fs in s:
            for f in fs:
                position.append(at)
                feature.append(names.setdefault(f, len(names)))
            at += 1
    position, feature = np.array(position, np.int64), np.array(feature, np.int64)
    sizes = np.array([len(s) for s in sequences])
    n, longest = at, int(sizes.max())
    starts = np.cumsum(sizes) - sizes
    grid = starts[:, None] + np.arange(longest)
    inside = np.arange(longest) < sizes[:, None]
    grid = np.where(inside, grid, n)
    y = np.append(np.concatenate([np.asarray(x) for x in labels if len(x)]), 0)
    yg = y[grid]
    pairs = inside[:, 1:]
    seen = np.array([[((yg[:, :-1] == i) & (yg[:, 1:] == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)
    first_seen = np.array([(yg[:, 0] == i).sum() for i in (0, 1)], float)
    w = np.zeros(len(names) + 6)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        start, trans = w[-6:-4], w[-4:].reshape(2, 2)
        e = np.append(np.bincount(position, w[feature], n), 0.0)[grid]
        e = np.stack([np.zeros_like(e), e], -1)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for k in range(1, longest):
            m = alpha[:, k - 1, :, None] + trans
            alpha[:, k] = np.where(inside[:, k, None], np.logaddexp(m[:, 0], m[:, 1]) + e[:, k], alpha[:, k - 1])
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        pair = np.zeros((2, 2))
        for k in range(longest - 2, -1, -1):
            m = trans + (e[:, k + 1] + beta[:, k + 1])[:, None, :]
            beta[:, k] = np.where(inside[:, k + 1, None], np.logaddexp(m[:, :, 0], m[:, :, 1]), 0.0)
            p = np.exp(alpha[:, k, :, None] + m - whole[:, None, None])
            pair += p[inside[:, k + 1]].sum(0)
        p1 = np.exp(alpha[..., 1] + beta[..., 1] - whole[:, None])
        flat = np.zeros(n + 1)
        flat[grid[inside]] = p1[inside]
        grad = np.concatenate([np.bincount(feature, (y[:n] - flat[:n])[position], len(names)), first_seen - np.array([(1 - p1[:, 0]).sum(), p1[:, 0].sum()]), (seen - pair).ravel()])
        grad -= penalty * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        w = w + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) * min(1.0, 2 * (1 - step / (rounds + 1)))
    kept = {f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}
    return Chain(kept, w[-6:-4].copy(), w[-4:].reshape(2, 2).copy())
