"""Edit distance of two word sequences within a band, by bit-parallel columns on Python's long integers."""

from __future__ import annotations

import numpy as np


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end, which no least alignment edits."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    start = int(apart[0]) if len(apart) else n
    a, b, n = a[start:], b[start:], n - start
    apart = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(apart[0]) if len(apart) else n
    return a[: len(a) - end], b[: len(b) - end]


def banded(a: list, b: list, band: int) -> int | None:
    """The distance if it is at most `band`, else None; len(a) >= len(b).

    Bit t of a column stands for row j - band + t, so that the band follows the diagonal: from one column to the next it
    moves down a row. plus and minus hold the vertical differences of +1 and -1. Rows above the first have neither, which
    gives the first row its growing distances; what comes in from outside the band is never less than it should be."""
    m, n = len(a), len(b)
    if m - n > band:
        return None
    at: dict = {}
    for p, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << p
    full = (1 << (2 * band + 1)) - 1
    plus, minus = (full >> band) << band, 0
    goal, distance = 1 << (band + m - n), m - n
    for j, x in enumerate(b):
        places, shift = at.get(x, 0), j - band
        same = (places >> shift if shift >= 0 else places << -shift) & full
        diagonal = (((same & plus) + plus) ^ plus) | same | minus
        across_plus = minus | ~(diagonal | plus)
        across_minus = diagonal & plus
        if not diagonal & goal:
            distance += 1
            if distance > band:
                return None
        below = (diagonal & full) >> 1
        plus = (across_minus | ~(below | across_plus)) & full
        minus = across_plus & below & full
    return distance


def distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The least number of inserted, deleted and replaced words that make a into b, if at most `most`, else None."""
    a, b = trimmed(a, b)
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    if not len(b):
        return len(a)
    x, y, band = a.tolist(), b.tolist(), 7
    while True:
        # Most pairs are either very near or far apart: a narrow band often says so.
        found = banded(x, y, min(band, most))
        if found is not None or band >= most:
            return found
        band *= 4
