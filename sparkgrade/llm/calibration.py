"""Calibration of scores by a logistic curve (Platt)."""

from __future__ import annotations

import numpy as np


def calibrated(x: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> tuple[float, float, float]:
    """Loss, slope and shift of a logistic regression, by Newton's method with a weak ridge, so that separable data end. rows: how many rows each value stands for."""
    if not len(x) or y.all() or not y.any():
        return 0.0, 1.0, -1.0
    n = np.ones(len(x)) if rows is None else rows
    scale = np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    ridge = np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (n * (p - y)) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(-np.average(np.where(y, np.log(p), np.log(1 - p)), weights=n)), float(w[0] / scale), float(w[1])
