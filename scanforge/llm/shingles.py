"""Hashes of words and word windows, computed over whole Arrow buffers with numpy.

A word is a maximal run of bytes other than space and tab to carriage return.
Hashes are polynomials modulo 2**64 over prefix sums, finished by a bit mixer,
so any window length costs the same.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and the number of words before each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_BREAK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(data)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of ``k`` consecutive words, whatever text they are in."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * inverse[: n - k + 1] + np.uint64(k))


def windows_in_texts(bounds: np.ndarray, k: int) -> np.ndarray:
    """True for each window start whose ``k`` words are of one text. bounds: words before each text."""
    n = int(bounds[-1])
    if n < k:
        return np.zeros(0, bool)
    fits = np.ones(n - k + 1, bool)
    for back in range(1, k):
        at = bounds[1:-1] - back
        at = at[(at >= 0) & (at < len(fits))]
        fits[at] = False
    return fits
