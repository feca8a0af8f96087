"""Words of many texts at once, as arrays: places, owners and 64-bit hashes, in a few numpy passes over the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64

_bytes = np.arange(256)
BLANK = (_bytes == 32) | ((_bytes >= 9) & (_bytes <= 13))
LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
_LETTER = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=U)
_BASE = U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([[U(1)], np.full(max(n, 4096) - 1, _BASE, U)]))
    return _POWERS[:n]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes of text each; a longer text stands alone."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to
        at = to


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins (and the end); nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


class Words:
    """start, end: of each word in bytes; first: the number of each text's first word (and the end); hash: 64 bits."""

    def __init__(self, body: np.ndarray, ends: np.ndarray, lower: bool = True):
        text = LOWER[body] if lower else body
        full = np.zeros(len(body) + 1, bool)
        full[:-1] = ~BLANK[text]
        begin = full.copy()
        begin[1:] &= ~full[:-1]
        inner = ends[:-1][(ends[:-1] < len(body)) & (ends[:-1] > 0)]
        begin[inner] = full[inner]
        stop = np.zeros(len(body) + 1, bool)
        stop[1:] = full[:-1] & (~full[1:] | begin[1:])
        self.text = text
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, ends)
        if len(self.start):
            size = self.end - self.start
            place = np.arange(len(body)) - np.repeat(self.start, np.diff(np.append(self.start, len(body)))) if self.start[0] == 0 else None
            if place is None:
                head = int(self.start[0])
                place = np.empty(len(body), np.int64)
                place[:head] = 0
                place[head:] = np.arange(head, len(body)) - np.repeat(self.start, np.diff(np.append(self.start, len(body))))
            terms = np.where(full[:-1], _LETTER[text] * powers(int(place.max()) + 1)[place], U(0))
            self.hash = mix(np.add.reduceat(terms, self.start) + U(0x632BE59BD9B4E019) * size.astype(U))
        else:
            self.hash = np.zeros(0, U)

    @property
    def owner(self) -> np.ndarray:
        """Of each word: the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hashes(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of many texts, and each text's number of words; read some megabytes at a time."""
    found, sizes = [], []
    at = 0
    while at < len(ends) - 1:
        to = min(max(int(np.searchsorted(ends, ends[at] + CHUNK_BYTES, "right")) - 1, at + 1), len(ends) - 1)
        w = Words(body[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        found.append(w.hash)
        sizes.append(np.diff(w.first))
        at = to
    return (np.concatenate(found), np.concatenate(sizes)) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def words(column: pa.Array, lower: bool = True) -> Words:
    return Words(*raw(column), lower)


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and each text's first run (and the end).

    A text with fewer than n words, but some, has its whole sequence as its one run.
    """
    size = np.diff(first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(begin[-1], U)
    if not len(out):
        return out, begin
    at = np.arange(len(out)) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    left = np.repeat(first[1:], count)
    short = np.repeat(size < n, count)
    h = np.append(h, U(0))
    for k in range(n):
        here = at + k
        inside = here < left
        out = np.where(inside, mix(out + h[np.minimum(here, len(h) - 1)] + U(k + 1)), out)
    return np.where(short, mix(out ^ U(0xA5A5A5A5)), out), begin
