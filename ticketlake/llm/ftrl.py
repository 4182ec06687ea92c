"""Sparse logistic regression by follow-the-regularised-leader updates, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal; the last coordinate is the intercept, which is not regularised."""

    def __init__(self, size: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.5, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2, self.size = alpha, beta, l1, l2, size
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def at(self, ids: np.ndarray) -> np.ndarray:
        """The weights of some coordinates: zero until their summed gradients exceed ``l1``."""
        z, n = self.z[ids], self.n[ids]
        free = ids == self.size
        l1 = np.where(free, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + np.where(free, 0.0, self.l2))
        return np.where(np.abs(z) > l1, w, 0.0)

    def update(self, ids: np.ndarray, x: np.ndarray, y: float) -> None:
        """One row: distinct coordinates, their values and the label."""
        ids, x = np.append(ids, self.size), np.append(x, 1.0)
        w = self.at(ids)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g

    def fit(self, rows: list, labels, epochs: int = 3, seed: int = 0) -> Ftrl:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                self.update(*rows[i], float(labels[i]))
        return self

    def weights(self) -> np.ndarray:
        return self.at(np.arange(self.size + 1))
