"""Cubic splines through a series' known points. Free of Spark, so that tasks can import it."""

from __future__ import annotations

import numpy as np


def second_derivatives(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the cubic spline through four points and more, whose third derivative does not jump at the second and last but one.

    The interior equations are tridiagonal, the ends' conditions put into the first and last of them: one pass on, one back.
    """
    h = np.diff(x).astype(float)
    s = np.diff(y) / h
    below, main, above, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(s)
    main[0] += h[0] * (1 + h[0] / h[1])
    above[0] -= h[0] ** 2 / h[1]
    main[-1] += h[-1] * (1 + h[-1] / h[-2])
    below[-1] -= h[-1] ** 2 / h[-2]
    n = len(main)
    for i in range(1, n):
        k = below[i] / main[i - 1]
        main[i] -= k * above[i - 1]
        right[i] -= k * right[i - 1]
    m = np.zeros(n + 2)
    m[n] = right[-1] / main[-1]
    for i in range(n - 2, -1, -1):
        m[i + 1] = (right[i] - above[i] * m[i + 2]) / main[i]
    m[0] = m[1] + (h[0] / h[1]) * (m[1] - m[2])
    m[-1] = m[-2] + (h[-1] / h[-2]) * (m[-2] - m[-3])
    return m


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline's values at places between the first and last point; a straight line with under four points; nan outside."""
    out = np.full(len(at), np.nan)
    inside = (at >= x[0]) & (at <= x[-1]) if len(x) else np.zeros(len(at), bool)
    if not inside.any():
        return out
    p = at[inside].astype(float)
    if len(x) < 4:
        out[inside] = np.interp(p, x, y)
        return out
    m, h = second_derivatives(x, y), np.diff(x).astype(float)
    i = np.clip(np.searchsorted(x, p, "right") - 1, 0, len(h) - 1)
    a, b = x[i + 1] - p, p - x[i]
    out[inside] = (m[i] * a**3 + m[i + 1] * b**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * a + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * b
    return out
