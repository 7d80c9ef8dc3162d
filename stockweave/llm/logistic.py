"""Ridge logistic regression on a bounded matrix."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, prior: np.ndarray | None = None, steps: int = 25) -> np.ndarray:
    """Weights for [1, x] by Newton steps; all but the first are drawn to `prior` (0). One class or no rows: the prior with a constant at the smoothed share."""
    rows = np.hstack((np.ones((len(x), 1)), x))
    w0 = np.concatenate(([0.0], np.zeros(x.shape[1]) if prior is None else prior))
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.concatenate(([np.log(share / (1 - share))], np.zeros(x.shape[1])))
    pull = np.full(rows.shape[1], ridge)
    pull[0] = 1e-6
    w = w0.copy()
    for _ in range(steps):
        p = sigmoid(rows @ w)
        slope = rows.T @ (y - p) - pull * (w - w0)
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + np.diag(pull + 1e-9), slope)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w
