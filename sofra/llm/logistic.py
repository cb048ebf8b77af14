"""A small weighted logistic regression for bounded training samples, fitted by Newton steps."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> dict:
    """y may hold probabilities. Columns are standardised; a constant column gets no weight. No rows: an even score."""
    if not len(x):
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "w": np.zeros(x.shape[1]), "b": 0.0}
    weight = np.ones(len(x)) if weight is None else weight
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        grad = z.T @ (weight * (p - y)) + penalty * w
        hess = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "w": w[:-1], "b": float(w[-1])}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z = ((x - model["mean"]) / model["scale"]) @ model["w"] + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
