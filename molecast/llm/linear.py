"""Sparse linear classifiers: follow-the-regularised-leader with elastic-net penalties, and temperature calibration.

These fit bounded samples of labelled rows on the driver; scoring is the callers' and runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Row = tuple[np.ndarray, np.ndarray]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Ftrl:
    """FTRL-proximal weights of ``classes`` linear scores over ``width`` features; the bias is not penalised."""

    width: int
    classes: int
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.5

    def __post_init__(self):
        self.z = np.zeros((self.width, self.classes))
        self.n = np.zeros((self.width, self.classes))
        self.bias_z, self.bias_n = np.zeros(self.classes), np.zeros(self.classes)

    def _solve(self, z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + l2))

    def weights(self, ids=slice(None)) -> np.ndarray:
        return self._solve(self.z[ids], self.n[ids], self.l1, self.l2)

    def bias(self) -> np.ndarray:
        return self._solve(self.bias_z, self.bias_n, 0.0, 0.0)

    def score(self, row: Row) -> np.ndarray:
        ids, values = row
        return values @ self.weights(ids) + self.bias()

    def step(self, row: Row, gradient: np.ndarray, bias: bool = True) -> None:
        """One update from the gradient of the loss by the scores at this row."""
        ids, values = row
        g = values[:, None] * gradient[None, :]
        w, n = self.weights(ids), self.n[ids]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[ids] += g - sigma * w
        self.n[ids] = n + g * g
        if bias:
            w = self.bias()
            sigma = (np.sqrt(self.bias_n + gradient**2) - np.sqrt(self.bias_n)) / self.alpha
            self.bias_z += gradient - sigma * w
            self.bias_n += gradient**2


def fit_multinomial(rows: list[Row], labels: np.ndarray, width: int, classes: int, epochs: int = 3, seed: int = 7, **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression."""
    model, rng = Ftrl(width, classes, **options), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            p = softmax(model.score(rows[i]))
            p[labels[i]] -= 1
            model.step(rows[i], p)
    return model.weights(), model.bias()


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature at which held-out logits have the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
