"""Multinomial logistic regression on sparse rows, trained by follow-the-regularised-leader."""

from __future__ import annotations

import numpy as np


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """rows: (feature numbers, values, class). Per-coordinate FTRL-proximal with an elastic net: l1 makes weights zero, l2 shrinks them.

    Returns weights [dims, classes] and the unpenalised bias [classes].
    """
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)

    def weights(zs: np.ndarray, ns: np.ndarray, penalised: bool = True) -> np.ndarray:
        one, two = (l1, l2) if penalised else (0.0, 0.0)
        return np.where(np.abs(zs) <= one, 0.0, -(zs - np.sign(zs) * one) / ((beta + np.sqrt(ns)) / alpha + two))

    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            at, x, y = rows[r]
            w, b = weights(z[at], n[at]), weights(z[dims], n[dims], False)
            g = softmax(x @ w + b)
            g[y] -= 1
            gw = x[:, None] * g
            z[at] += gw - (np.sqrt(n[at] + gw * gw) - np.sqrt(n[at])) / alpha * w
            n[at] += gw * gw
            z[dims] += g - (np.sqrt(n[dims] + g * g) - np.sqrt(n[dims])) / alpha * b
            n[dims] += g * g
    return weights(z[:dims], n[:dims]), weights(z[dims], n[dims], False)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that training did not see."""
    if not len(labels):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])
