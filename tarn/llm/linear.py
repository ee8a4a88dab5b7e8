"""Logistic regression on sparse rows, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def fit_logistic(
    indices: np.ndarray,
    values: np.ndarray,
    starts: np.ndarray,
    target: np.ndarray,
    size: int,
    ridge: float,
    rounds: int = 200,
) -> tuple[np.ndarray, float]:
    """Weights and bias that fit soft targets in 0..1; row i has the entries starts[i]:starts[i + 1].

    Accelerated gradient descent on the mean log loss plus a ridge, with the
    step from the rows' mean norm. The same rows give the same model.
    """
    n = len(target)
    weights, bias = np.zeros(size), 0.0
    if not n:
        return weights, bias
    row = np.repeat(np.arange(n), np.diff(starts))
    # Features come in one scale, so that one step length suits all of them.
    scale = np.sqrt(np.bincount(indices, weights=values * values, minlength=size) / n)
    scale = np.where(scale > 0, scale, 1.0) ** 0.5
    x = values / scale[indices]
    norms = np.bincount(row, weights=x * x, minlength=n) + 1.0
    # The mean row norm is the trace, and so a bound, of the matrix that bounds the loss's curvature.
    step = 1.0 / (0.25 * norms.mean() + ridge)
    prior = min(max(target.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(prior / (1 - prior)))
    at, at_bias, momentum = weights.copy(), bias, 1.0
    for _ in range(rounds):
        margin = np.bincount(row, weights=x * at[indices], minlength=n) + at_bias
        error = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - target
        slope = np.bincount(indices, weights=x * error[row], minlength=size) / n + ridge * at
        new, new_bias = at - step * slope, at_bias - step * error.mean()
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        ahead = (momentum - 1) / after
        at, at_bias = new + ahead * (new - weights), new_bias + ahead * (new_bias - bias)
        weights, bias, momentum = new, new_bias, after
    return weights / scale, float(bias)


def probability(margin: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-min(max(margin, -30.0), 30.0))))
