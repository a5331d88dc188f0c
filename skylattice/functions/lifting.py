"""Wavelet decomposition by the lifting scheme on irregular grids.

A level splits a signal into details, each a value less what its neighbours on both sides predict for its time, and a
coarse signal, the values updated by a quarter of the details around them, which the next level splits again at twice
the distance. No position is left out from level to level (the redundant form), so details don't depend on where a
feature begins. Details of straight motion are zero whatever the spacing, so gaps and speed leave no trace in them.
"""

from __future__ import annotations

import numpy as np


def runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, length) of each run of exactly equal successive values (zero first-level detail)."""
    if not len(v):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return first, np.diff(np.r_[first, len(v)])


def predict(t: np.ndarray, v: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The value at each position's time on the line through two others."""
    span = np.maximum(t[after] - t[before], 1e-9)
    share = (t[at] - t[before]) / span
    return v[before] + (v[after] - v[before]) * share


def decompose(t: np.ndarray, v: np.ndarray, levels: int | None = None) -> list[np.ndarray]:
    """Details of each level, as long as ``v``; level ``k`` predicts over a distance of ``2**k`` positions.

    Near the ends the first or last value stands in for a neighbour beyond them; these two have no detail themselves
    (NaN). Levels go on until the distance exceeds the length.
    """
    n, out, s, reach = len(v), [], np.asarray(v, np.float64), 1
    at = np.arange(1, n - 1)
    while n > 2 and reach < n and (levels is None or len(out) < levels):
        d = np.full(n, np.nan)
        d[at] = s[at] - predict(t, s, at, np.maximum(at - reach, 0), np.minimum(at + reach, n - 1))
        out.append(d)
        known = np.nan_to_num(d)
        update = np.zeros(n)
        update[reach:] += known[:-reach]
        update[:-reach] += known[reach:]
        s, reach = s + update / 4, 2 * reach
    return out


def details(t: np.ndarray, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(detail of the middle of every run of ``width`` values against the values just before and after it, time between these)."""
    n = len(v) - width - 1
    if n <= 0:
        return np.zeros(0), np.zeros(0)
    before = np.arange(n)
    after, mid = before + width + 1, before + 1 + width // 2
    return v[mid] - predict(t, v, mid, before, after), t[after] - t[before]
