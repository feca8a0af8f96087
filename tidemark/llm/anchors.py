"""Anchors of byte strings: places chosen by content, such that equal strings of SPAN bytes hold the same anchor.

Each start of a SPAN-byte string belongs to the smallest K-byte hash inside it (rightmost of equal ones). Starts that
share an anchor are a run; the bytes the run's strings cover are the anchor's context.
"""

from __future__ import annotations

import numpy as np

from .words import U, _LETTER, mix, powers

SPAN = 200
K = 100
WINDOW = SPAN - K + 1
PIECE = 1 << 20  # a longer body is read in pieces that overlap by SPAN - 1 bytes
_TOP = PIECE + 4 * SPAN
_PLACE = U((1 << 24) - 1)


def least(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w neighbours, by doubling."""
    out, have = v, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(body: np.ndarray) -> list[np.ndarray]:
    """Of one text: hash of each anchor, hash of its context, first start of its run, and last start less first."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, max(len(body) - SPAN + 1, 0), PIECE):
        part = body[at : at + PIECE + SPAN - 1]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_LETTER[part] * powers(_TOP)[: len(part)], out=sums[1:])
        back = powers(_TOP)[::-1]
        place = np.arange(len(part) - K + 1)
        h = mix((sums[K:] - sums[:-K]) * back[place])
        v = least((h & ~_PLACE) | (_PLACE - place.astype(U)), WINDOW)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        last = np.append(first[1:], len(v)) - 1
        anchor = (_PLACE - (v[first] & _PLACE)).astype(np.int64)
        end = last + SPAN
        context = mix((sums[end] - sums[first]) * back[first] + (end - first).astype(U) * U(0x9E3779B97F4A7C15) + mix((anchor - first).astype(U)))
        for to, x in zip(found, (h[anchor].astype(np.int64), context.astype(np.int64), first + at, last - first), strict=True):
            to.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
