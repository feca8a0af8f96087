"""Small convex problems over one portfolio's weights. Free of Spark, so that tasks can import it."""

from __future__ import annotations

import numpy as np
import pandas as pd


def matrix(rows: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    cov = rows.pivot(index="a", columns="b", values="cov").sort_index(axis=0).sort_index(axis=1).fillna(0.0)
    mean = rows.groupby("a")["mean"].first().sort_index()
    return list(cov.index), (cov.to_numpy() + cov.to_numpy().T) / 2, mean.to_numpy()


def onto_simplex(v: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """The nearest weights that sum to 1 within the bounds, by bisection on the shift."""
    if high * len(v) < 1 or low * len(v) > 1:
        raise ValueError("bounds leave no weights that sum to 1")
    if low == 0 and high >= 1:  # the shift follows from the sorted values
        u = np.sort(v)[::-1]
        shift = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
        return np.maximum(v - shift[np.flatnonzero(u > shift)[-1]], 0.0)
    a, z = v.min() - high - 1, v.max() - low + 1
    for _ in range(100):
        m = (a + z) / 2
        if np.clip(v - m, low, high).sum() > 1:
            a = m
        else:
            z = m
    return np.clip(v - (a + z) / 2, low, high)


def least_variance(cov: np.ndarray, tilt: np.ndarray | None = None, low: float = 0.0, high: float = 1.0, steps: int = 3000) -> np.ndarray:
    """Weights with least w'Cw / 2 - tilt'w, by accelerated projected gradient."""
    n = len(cov)
    tilt = np.zeros(n) if tilt is None else tilt
    rate = 1 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)
    w = y = onto_simplex(np.full(n, 1 / n), low, high)
    t = 1.0
    for _ in range(steps):
        new = onto_simplex(y - rate * (cov @ y - tilt), low, high)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-12:
            return new
        w, t = new, t2
    return w


def most_sharpe(cov: np.ndarray, mean: np.ndarray, rf: float, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Best ratio of excess return to deviation: the frontier is walked by its tilt and the best point refined."""
    excess = mean - rf
    ratio = lambda w: (w @ excess) / max((w @ cov @ w) ** 0.5, 1e-12)
    grid = np.concatenate([[0.0], np.geomspace(1e-3, 1e3, 40)])
    best = max(grid, key=lambda k: ratio(least_variance(cov, k * excess, low, high, 800)))
    a, z = best / 1.5, best * 1.5 + 1e-6
    for _ in range(25):
        p, q = a + 0.382 * (z - a), a + 0.618 * (z - a)
        if ratio(least_variance(cov, p * excess, low, high, 800)) > ratio(least_variance(cov, q * excess, low, high, 800)):
            z = q
        else:
            a = p
    return least_variance(cov, (a + z) / 2 * excess, low, high)


def equal_risk(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights whose risk contributions are equal, by coordinate steps on the convex form with a log barrier."""
    n = len(cov)
    x = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-12))
    for _ in range(rounds):
        before = x.copy()
        for i in range(n):
            rest = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-rest + (rest * rest + 4 * cov[i, i] / n) ** 0.5) / (2 * max(cov[i, i], 1e-12))
        if np.abs(x - before).max() < 1e-13:
            break
    return x / x.sum()


LEAST_EIGENVALUE, MOST_CONDITION, STRENGTH = 1e-8, 1e12, 1e-6


def condition(cov: np.ndarray) -> tuple[float, float]:
    """The least eigenvalue, and the largest over it."""
    values = np.linalg.eigvalsh(cov)
    return float(values[0]), float(values[-1] / max(values[0], 1e-15))


def repaired(cov: np.ndarray, method: str = "eigenvalue", strength: float = STRENGTH, least: float = LEAST_EIGENVALUE) -> tuple[np.ndarray, str]:
    """A positive definite matrix near cov, and what was done: nothing, the method, or the diagonal if the method fails.

    Methods: eigenvalue (a floor under the eigenvalues), ridge (`strength` on the diagonal), shrinkage (toward the mean variance).
    """
    low, ratio = condition(cov)
    if low > least and ratio < MOST_CONDITION:
        return cov, "none"
    n = len(cov)
    if method == "eigenvalue":
        values, vectors = np.linalg.eigh(cov)
        out = vectors * np.maximum(values, least) @ vectors.T
    elif method == "ridge":
        out = cov + strength * np.eye(n)
    elif method == "shrinkage":
        out = (1 - strength) * cov + strength * np.trace(cov) / n * np.eye(n)
    else:
        raise ValueError(f"unknown method: {method}")
    out = (out + out.T) / 2
    if condition(out)[0] <= 0:
        return np.diag(np.maximum(np.diag(cov), least)), "diagonal"
    return out, method
