"""Sparse multinomial logistic regression, trained online by follow-the-regularised-leader."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Penalties:
    """Learning rate and elastic-net penalties of the training."""

    alpha: float
    l1: float
    l2: float
    beta: float = 1.0
    epochs: int = 4


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def _weights(z: np.ndarray, n: np.ndarray, how: Penalties, l1: np.ndarray) -> np.ndarray:
    """The leader: zero where the summed gradients stay within the L1 penalty."""
    pulled = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
    return -pulled / ((how.beta + np.sqrt(n)) / how.alpha + how.l2)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    targets: np.ndarray,
    dims: int,
    how: Penalties,
    importance: np.ndarray | None = None,
) -> np.ndarray:
    """Weights (dims + 1, classes) from sparse rows (indices, values) and target probabilities.

    The last row of the weights is the intercept, which carries no L1 penalty. Rows are visited in a
    fixed random order in each epoch.
    """
    classes = targets.shape[1]
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    order = np.random.default_rng(0)
    weight = np.ones(len(rows)) if importance is None else importance
    for _ in range(how.epochs):
        for r in order.permutation(len(rows)):
            own = np.append(rows[r][0], dims)
            values = np.append(rows[r][1], 1.0)[:, None]
            l1 = np.where(own == dims, 0.0, how.l1)[:, None]
            w = _weights(z[own], n[own], how, l1)
            gap = softmax((values * w).sum(axis=0)) - targets[r]
            g = weight[r] * values * gap
            grown = n[own] + g * g
            z[own] += g - (np.sqrt(grown) - np.sqrt(n[own])) / how.alpha * w
            n[own] = grown
    l1 = np.full((dims + 1, 1), how.l1)
    l1[dims] = 0.0
    return _weights(z, n, how, l1)


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the scores with the least log loss on held-back rows, by repeated narrowing."""
    low, high = -3.0, 3.0
    if not len(scores):
        return 1.0
    for _ in range(6):
        tried = np.linspace(low, high, 13)
        loss = [-np.log(softmax(scores / np.exp(t))[np.arange(len(truth)), truth] + 1e-300).mean() for t in tried]
        best, step = tried[int(np.argmin(loss))], (high - low) / 12
        low, high = best - step, best + step
    return float(np.exp(best))
