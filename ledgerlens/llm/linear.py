"""A regularised linear classifier on hashed features, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Sparse rows of equal weight within a row, and dense columns beside them.

    ``index`` holds the hashed features of all rows one after another, ``start`` where each row begins.
    A row's features weigh 1 / sqrt(their count), so that long rows don't outweigh short ones.
    """

    def __init__(self, index: np.ndarray, start: np.ndarray, dense: np.ndarray):
        self.index, self.start, self.dense = index, start, dense
        counts = np.diff(np.append(start, len(index)))
        self.row = np.repeat(np.arange(len(start)), counts)
        self.scale = 1.0 / np.sqrt(np.maximum(counts, 1))

    def dot(self, w: np.ndarray, wd: np.ndarray, b: float) -> np.ndarray:
        sums = np.bincount(self.row, weights=w[self.index], minlength=len(self.start))
        return sums * self.scale + self.dense @ wd + b


def fit_logistic(x: Rows, y: np.ndarray, weight: np.ndarray, dim: int, l2: float = 1e-6, rounds: int = 60, memory: int = 8, start: tuple[np.ndarray, np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the hashed and dense features and the bias: L2-regularised logistic loss, rows weighted, by L-BFGS.

    The loss has one minimum; a ``start`` near it (a fit to like rows) saves rounds.
    """
    k = x.dense.shape[1]
    weight = weight / weight.sum()

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        w, wd, b = t[:dim], t[dim : dim + k], t[-1]
        z = x.dot(w, wd, b)
        value = float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + l2 * (t[:-1] @ t[:-1]) / 2)
        g = weight * (sigmoid(z) - y)
        grad = np.empty_like(t)
        grad[:dim] = np.bincount(x.index, weights=(g * x.scale)[x.row], minlength=dim)
        grad[dim : dim + k] = x.dense.T @ g
        grad[:-1] += l2 * t[:-1]
        grad[-1] = g.sum()
        return value, grad

    t = np.zeros(dim + k + 1) if start is None else np.concatenate([start[0], start[1], [start[2]]])
    value, grad = loss(t)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d in reversed(steps):
            alphas.append((s @ q) / (s @ d))
            q -= alphas[-1] * d
        if steps:
            q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, d), a in zip(steps, reversed(alphas)):
            q += s * (a - (d @ q) / (s @ d))
        size, slope = 1.0 if steps else 1.0 / max(np.abs(grad).sum(), 1e-12), grad @ q
        if slope < 1e-12:
            break
        while True:
            new = t - size * q
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        s, d = new - t, new_grad - grad
        if s @ d > 1e-12:
            steps = [*steps, (s, d)][-memory:]
        done = abs(value - new_value) < 1e-7 * max(1.0, value)
        t, value, grad = new, new_value, new_grad
        if done:
            break
    return t[:dim], t[dim : dim + k], float(t[-1])
