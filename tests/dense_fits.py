"""Fits on whole arrays by other methods than the library's, to hold its results against."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ratefield.operators.regress import nb_log_likelihood


def _weighted_fit(y, x, offset, alpha, beta, steps=100):
    for _ in range(steps):
        mu = np.exp(np.clip(x @ beta + offset, -30, 30))
        w = mu / (1 + alpha * mu)
        step = np.linalg.lstsq(x.T @ (w[:, None] * x) + 1e-10 * np.eye(x.shape[1]), x.T @ ((y - mu) / (1 + alpha * mu)), rcond=None)[0]
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return beta


def fit_nb(y, x, offset):
    """Coefficients and dispersion of a negative binomial regression: a Poisson start, then a golden-section search over log alpha."""
    y, x, offset = (np.asarray(v, float) for v in (y, x, offset))
    start = np.linalg.lstsq(x, np.log(np.maximum(y, 0.5)) - offset, rcond=None)[0]
    start = _weighted_fit(y, x, offset, 0.0, start)

    def fitted(log_alpha):
        a = np.exp(log_alpha)
        beta = _weighted_fit(y, x, offset, a, start)
        return float(nb_log_likelihood(y, np.exp(np.clip(x @ beta + offset, -30, 30)), a).sum()), beta

    low, high, g = -9.0, 4.0, (5**0.5 - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = fitted(a)[0], fitted(b)[0]
    for _ in range(60):
        if fa < fb:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = fitted(b)[0]
        else:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = fitted(a)[0]
    best = 0.5 * (low + high)
    ll, beta = fitted(best)
    return beta, float(np.exp(best)), ll


def design(table: pd.DataFrame, columns: list[str], groups: list[str], group: str) -> np.ndarray:
    """Covariates and a column for each group, so there is no intercept."""
    dummies = np.array([[g == k for k in groups] for g in table[group]], float).reshape(len(table), len(groups))
    return np.column_stack([table[columns].to_numpy(float), dummies]) if columns else dummies
