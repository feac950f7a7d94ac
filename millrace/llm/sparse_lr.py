"""Sparse multinomial logistic regression: follow-the-regularised-leader with elastic net, then temperature calibration.

Small numeric helpers that run inside one task over a bounded sample; Spark makes the features and scores all rows.
"""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, features: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 3, seed: int = 0) -> np.ndarray:
    """Weights (features + 1, classes), the last row the bias. rows: sorted feature numbers and values of each example.

    Per coordinate: z gathers gradients less the drift of the weight, n their squares; the weight is 0 while |z| <= l1.
    """
    z, n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
    penal = np.full((features + 1, 1), l1)
    penal[-1] = 0.0

    def weight(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= penal[at], 0.0, -(zz - np.sign(zz) * penal[at]) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, features), np.append(x, 1.0)
            w = weight(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    return weight(np.arange(features + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """The temperature of least (weighted) log loss on examples that the weights have not seen: golden-section search on its log."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.average(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)), weights=weights)

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))
