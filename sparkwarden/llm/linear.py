"""Linear models over sparse 0/1 features, fitted on a bounded sample: rows are arrays of feature numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Rows:
    """Sparse rows; every row has at least one feature."""

    values: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return cls(np.concatenate(rows) if rows else np.empty(0, np.int32), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Rows:
        return Rows.of([self.values[self.starts[k] : self.starts[k + 1]] for k in rows])

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.values], self.starts[:-1]) if len(self) else np.empty(0)

    def gradient(self, residual: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.values, np.repeat(residual, np.diff(self.starts)), dims)


def fit(rows: Rows, dims: int, slope: Callable[[np.ndarray, np.ndarray], np.ndarray], epochs: int = 12, batch: int = 512, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> np.ndarray:
    """Weights by AdaGrad; slope(row numbers, scores) gives the loss's slope in each row's score, over the batch's mean."""
    w, seen, rng = np.zeros(dims), np.full(dims, 1e-6), np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            now = order[s : s + batch]
            part = rows.take(now)
            g = part.gradient(slope(now, part.scores(w)), dims) + decay * w
            seen += g * g
            w -= rate * g / np.sqrt(seen)
    return w


def logistic(targets: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Cross-entropy against soft labels."""
    return lambda now, z: (sigmoid(z) - targets[now]) / len(now)
