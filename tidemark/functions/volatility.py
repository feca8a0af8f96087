"""GARCH(1,1) with a constant mean for one series, and tests of what it leaves. Free of Spark, so that tasks can import it."""

from __future__ import annotations

import math

import numpy as np

BACKCAST, BACKCAST_ROWS = 0.94, 75
EWMA = 0.94


def start_variance(e2: np.ndarray) -> float:
    """The variance before the first row: a falling average of the first squares."""
    w = BACKCAST ** np.arange(min(len(e2), BACKCAST_ROWS))
    return float(e2[: len(w)] @ w / w.sum())


def variances(y: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Conditional variances (rows, sets) of parameter sets (mean, omega, alpha, beta); one pass over the rows for all sets."""
    mean, omega, alpha, beta = params.T
    e2 = (y[:, None] - mean) ** 2
    w = BACKCAST ** np.arange(min(len(y), BACKCAST_ROWS))
    first = w @ e2[: len(w)] / w.sum()
    out = np.empty_like(e2)
    out[0] = omega + (alpha + beta) * first
    for t in range(1, len(y)):
        out[t] = omega + alpha * e2[t - 1] + beta * out[t - 1]
    return out


def log_likelihood(y: np.ndarray, params: np.ndarray) -> np.ndarray:
    """Of each parameter set, with normal errors; minus infinity outside the allowed region."""
    mean, omega, alpha, beta = params.T
    fine = (omega > 0) & (alpha >= 0) & (beta >= 0) & (alpha + beta < 1)
    out = np.full(len(params), -np.inf)
    if fine.any():
        v = variances(y, params[fine])
        out[fine] = -0.5 * (np.log(2 * np.pi) + np.log(v) + (y[:, None] - mean[fine]) ** 2 / v).sum(0)
    return out


def garch(y: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float, bool]:
    """(mean, omega, alpha, beta), log likelihood, and whether the search ended by itself.

    A grid over alpha and beta with the variance of the series gives the start, at which a simplex is let down. Mean and omega
    are searched in units of the series, so that its scale does not matter.
    """
    mean, var = float(y.mean()), float(y.var())
    if not var > 0:
        return np.array([mean, 0.0, 0.0, 0.0]), -np.inf, False
    x = (y - mean) / math.sqrt(var)
    alpha, share = (g.ravel() for g in np.meshgrid([0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5], [0.0, 0.2, 0.5, 0.7, 0.85, 0.92, 0.96, 0.985, 0.995]))
    beta = np.maximum(share - alpha, 0.0)
    grid = np.column_stack([np.zeros(len(alpha)), 1 - alpha - beta, alpha, beta])
    start = grid[np.argmax(log_likelihood(x, grid))]
    simplex = np.vstack([start, *(start + d for d in np.diag([0.05, 0.02, 0.02, -0.02]))])
    simplex[:, 2:] = np.clip(simplex[:, 2:], 1e-6, None)
    simplex[:, 1] = np.maximum(simplex[:, 1], 1e-6)
    over = simplex[:, 2] + simplex[:, 3] >= 1
    simplex[over, 3] = 0.999 - simplex[over, 2]
    score = log_likelihood(x, simplex)
    done = False
    for _ in range(rounds):
        order = np.argsort(-score)
        simplex, score = simplex[order], score[order]
        if score[0] - score[-1] < 1e-10 and np.abs(simplex - simplex[0]).max() < 1e-7:
            done = True
            break
        centre = simplex[:-1].mean(0)
        tries = centre + np.array([1.0, 2.0, 0.5, -0.5])[:, None] * (centre - simplex[-1])
        found = log_likelihood(x, tries)
        if found[0] > score[0]:
            best = 1 if found[1] > found[0] else 0
        elif found[0] > score[-2]:
            best = 0
        else:
            best = 2 if found[2] >= max(found[0], score[-1]) else 3
        if best < 2 or found[best] > score[-1]:
            simplex[-1], score[-1] = tries[best], found[best]
        else:
            simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
            score[1:] = log_likelihood(x, simplex[1:])
    m, omega, a, b = simplex[np.argmax(score)]
    scale = math.sqrt(var)
    return np.array([mean + scale * m, omega * var, a, b]), float(score.max() - len(y) * math.log(scale)), done


def correlations(x: np.ndarray, lags: int) -> list[float]:
    """Of a series with itself, lag by lag, each over its own rows; undefined ones are left out."""
    out = []
    for k in range(1, lags + 1):
        a, b = x[k:] - x[k:].mean(), x[:-k] - x[:-k].mean()
        free = math.sqrt(float(a @ a) * float(b @ b))
        if free > 0:
            out.append(float(a @ b) / free)
    return out


def upper_gamma(s: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    head = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * head)
    b = x + 1 - s  # a continued fraction, from the front
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - s)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def serial_p(x: np.ndarray, lags: int = 10) -> float | None:
    """Ljung and Box's test of serial correlation; null for short series."""
    n = len(x)
    if n <= lags + 5:
        return None
    rho = correlations(x, lags)
    if not rho:
        return None
    q = n * (n + 2) * sum(r * r / (n - k - 1) for k, r in enumerate(rho))
    return upper_gamma(len(rho) / 2, q / 2)


def arch_p(x: np.ndarray, lags: int = 5) -> float | None:
    """A test of changing variance, from the summed sizes of the squares' correlations; null for short series."""
    if len(x) <= lags + 10:
        return None
    size = sum(map(abs, correlations(x * x, lags)))
    return min(1.0, math.erfc(size * math.sqrt(len(x)) / math.sqrt(2)))


def ewma_variances(x: np.ndarray, keep: float = EWMA) -> np.ndarray:
    """Exponentially weighted variance about the weighted mean up to each row, corrected for its weights; 0 for the first row."""
    out = np.zeros(len(x))
    w = w2 = s = q = 0.0
    for t, v in enumerate(x):
        w, w2, s, q = w * keep + 1, w2 * keep * keep + 1, s * keep + v, q * keep + v * v
        free = w * w - w2
        if free > 0:
            out[t] = max(0.0, q / w - (s / w) ** 2) * w * w / free
    return out
