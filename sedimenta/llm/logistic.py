"""Logistic regression in numpy for small, bounded design matrices."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 40, weight: np.ndarray | None = None) -> dict:
    """Newton's method on standardised columns; one class only, or no rows, gives its smoothed share for all."""
    y = np.asarray(y, float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    center = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale[scale < 1e-9] = 1
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        z = np.hstack([(x - center) / scale, np.ones((len(x), 1))])
        penalty = np.full(len(w), l2)
        penalty[-1] = 1e-6
        c = np.ones(len(y)) if weight is None else weight
        for _ in range(rounds):
            p = sigmoid(z @ w)
            step = np.linalg.solve((z * (c * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty), z.T @ (c * (p - y)) + penalty * w)
            w -= step * min(1, 4 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
    return {"center": center, "scale": scale, "w": w}


def logits(model: dict, x: np.ndarray) -> np.ndarray:
    return ((x - model["center"]) / model["scale"]) @ model["w"][:-1] + model["w"][-1]
