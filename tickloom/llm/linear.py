"""Sparse logistic regression on a few thousand chosen features, for bounded training samples."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Binary logistic regression on presence features (lists of column numbers) and dense columns."""

    def __init__(self, l2: float = 1e-3, rounds: int = 300, rate: float = 0.5):
        self.l2, self.rounds, self.rate = l2, rounds, rate

    def fit(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray, y: np.ndarray, width: int) -> "Logistic":
        """(rows, columns): places of the ones in a matrix of len(y) rows; Adagrad on all rows at once."""
        n = max(len(y), 1)
        self.weights, self.dense = np.zeros(width), np.zeros(dense.shape[1])
        share = min(max((y.sum() + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        sums = [np.full(width, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
        for _ in range(self.rounds):
            error = sigmoid(self.logits(rows, columns, dense)) - y
            grads = (
                np.bincount(columns, error[rows], width) / n + self.l2 * self.weights / n,
                dense.T @ error / n + self.l2 * self.dense / n,
                error.sum() / n,
            )
            for i, g in enumerate(grads):
                sums[i] = sums[i] + g * g
            self.weights -= self.rate * grads[0] / np.sqrt(sums[0])
            self.dense -= self.rate * grads[1] / np.sqrt(sums[1])
            self.bias -= self.rate * grads[2] / np.sqrt(sums[2])
        return self

    def logits(self, rows: np.ndarray, columns: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rows, self.weights[columns], len(dense)) + dense @ self.dense + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def associated(features: np.ndarray, rows: np.ndarray, y: np.ndarray, least: int, z: float, most: int) -> np.ndarray:
    """Sorted distinct features whose smoothed log odds of occurring in positive rows stand out by ``z`` errors.

    (features, rows): distinct features of each row. Positive and negative association both count.
    """
    names, at = np.unique(features, return_inverse=True)
    ones = np.bincount(at, y[rows], len(names))
    all_ = np.bincount(at, minlength=len(names))
    n1, n = y.sum(), len(y)
    a, b = ones + 0.5, n1 - ones + 0.5
    c, d = all_ - ones + 0.5, (n - n1) - (all_ - ones) + 0.5
    score = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    score[all_ < least] = 0
    good = np.flatnonzero(score >= z)
    good = good[np.argsort(-score[good], kind="stable")][:most]
    return np.sort(names[good])


def present(features: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the features that were chosen."""
    if not len(chosen) or not len(features):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, features), len(chosen) - 1)
    hit = chosen[at] == features
    return rows[hit], at[hit]
