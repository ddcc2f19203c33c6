"""Logistic regression on a bounded sample, on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, intercept: bool = True,
                 rounds: int = 400) -> np.ndarray:
    """Weights (the intercept last) that minimise mean logistic loss plus ``ridge`` / 2 times their
    squared length, by accelerated gradient descent with restarts. The intercept is not shrunk."""
    n, k = x.shape
    w = np.zeros(k + 1)
    if n == 0:
        return w
    moved, speed = w.copy(), 1.0
    # A bound of the curvature: the largest eigenvalue of x'x / 4n, by power iteration.
    v = np.ones(k, dtype=x.dtype)
    for _ in range(20):
        v = x.T @ (x @ v)
        norm = np.linalg.norm(v)
        if norm == 0:
            break
        v /= norm
    top = np.linalg.norm(x.T @ (x @ v)) / (4 * n) if k else 0.0
    step = 1.0 / (2 * (top + 0.25) + ridge)
    shrink = np.append(np.full(k, ridge), 0.0)
    for _ in range(rounds):
        error = sigmoid(x @ moved[:k].astype(x.dtype) + moved[k]) - y
        slope = np.append(x.T @ error.astype(x.dtype) / n, error.mean() if intercept else 0.0) + shrink * moved
        ahead = moved - step * slope
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        if slope @ (ahead - w) > 0:
            faster, moved = 1.0, ahead
        else:
            moved = ahead + (speed - 1) / faster * (ahead - w)
        if np.abs(ahead - w).max() < 1e-6:
            w = ahead
            break
        w, speed = ahead, faster
    return w
