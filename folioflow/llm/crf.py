"""A linear-chain conditional random field over real-valued features, in numpy."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class ChainCRF:
    """Scores: emission (features x labels), transition (label x label), start (label)."""

    def __init__(self, labels: list[str], width: int):
        n = len(labels)
        self.labels, self.width = labels, width
        self.emit, self.trans, self.start = np.zeros((width, n)), np.zeros((n, n)), np.zeros(n)

    def fit(self, x: list[np.ndarray], y: list[list[int]], steps: int = 400, rate: float = 0.1, l2: float = 0.0002, piece: int = 64) -> None:
        """Maximises the penalised conditional likelihood by Adam, on all sequences in each step.

        Sequences of one length are taken together, so that none is padded; those
        longer than ``piece`` are trained on in pieces of that length.
        """
        by_length: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
        for a, b in zip(x, y):
            for k in range(0, len(a), piece):
                by_length.setdefault(len(a[k : k + piece]), []).append((a[k : k + piece], b[k : k + piece]))
        groups = [(np.stack([a for a, _ in g]), np.eye(len(self.labels))[np.array([b for _, b in g])]) for _, g in sorted(by_length.items())]
        n = sum(len(f) for f, _ in groups)
        params = [self.emit, self.trans, self.start]
        want = [
            sum(np.tensordot(f, hot, ([0, 1], [0, 1])) for f, hot in groups),
            sum(np.tensordot(hot[:, :-1], hot[:, 1:], ([0, 1], [0, 1])) for _, hot in groups),
            sum(hot[:, 0].sum(axis=0) for _, hot in groups),
        ]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            grads = [-w for w in want]
            for f, _ in groups:
                for g, e in zip(grads, self._expected(f)):
                    g += e
            for p, g, a, b in zip(params, grads, first, second):
                g = g / n + l2 * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)

    def _expected(self, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts for (emission, transition, start) in sequences of one length."""
        n, length, _ = feats.shape
        unary = feats @ self.emit
        alpha, beta = np.empty_like(unary), np.zeros_like(unary)
        alpha[:, 0] = unary[:, 0] + self.start
        for t in range(1, length):
            alpha[:, t] = _lse(alpha[:, t - 1, :, None] + self.trans, 1) + unary[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(self.trans + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + self.trans + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        return np.tensordot(feats, node, ([0, 1], [0, 1])), pair.sum(axis=(0, 1)), node[:, 0].sum(axis=0)

    def tag(self, x: np.ndarray) -> list[int]:
        """The most probable labels of one sequence."""
        if not len(x):
            return []
        unary = x @ self.emit
        score, back = unary[0] + self.start, []
        for t in range(1, len(x)):
            both = score[:, None] + self.trans
            back.append(both.argmax(axis=0))
            score = both.max(axis=0) + unary[t]
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]
