"""Units of 20 bases and more, which reads hold with errors: approximate coverage and approximate equality."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np

#: Units of so many bases and more are handled approximately.
LONG = 20
#: Bases that begin a stretch and must agree exactly.
SEED = 3


def tolerance(length: int, ratio: float) -> int:
    """Differences that a copy of a unit may have; the product is taken in single precision."""
    return math.ceil(float(np.float32(length) * np.float32(ratio)))


def extents(codes: np.ndarray, unit: np.ndarray, ratio: float, phases: Iterable[int] | None = None) -> np.ndarray:
    """By start: bases of the whole copies that follow an exact seed there, in the phase where they are most.

    Copies are laid along the read without gaps; each may differ in
    tolerance() bases. Every phase is one diagonal, and the copies that follow
    a place are counted from the end of the read. phases: the diagonals to look
    at, all by default.
    """
    n, size = len(codes), len(unit)
    best = np.zeros(n, np.int64)
    if n < SEED + size:
        return best
    most = tolerance(size, ratio)
    rows = -(-n // size) + 2
    for phase in range(size) if phases is None else phases:
        same = codes == np.resize(np.roll(unit, phase), n)
        wrong = np.concatenate([[0], np.cumsum(~same)])
        good = np.zeros(rows * size, bool)
        good[: n - size + 1] = wrong[size:] - wrong[:-size] <= most
        copies = np.zeros((rows, size), np.int64)
        for r, ok in reversed(list(enumerate(good.reshape(rows, size)[:-1]))):
            copies[r] = np.where(ok, copies[r + 1] + 1, 0)
        seeded = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        best[seeded] = np.maximum(best[seeded], copies.reshape(-1)[seeded + SEED] * size)
    return best


def coverage(codes: np.ndarray, unit: np.ndarray, reps: int, ratio: float, phases: Iterable[int] | None = None) -> np.ndarray | None:
    """Which bases lie in stretches of reps copies and more, taken from the left without overlap; None if there are none."""
    found = extents(codes, unit, ratio, phases)
    out = np.zeros(len(codes), bool)
    at = 0
    for start in np.flatnonzero(found >= reps * len(unit)).tolist():
        if start >= at:
            at = start + SEED + int(found[start])
            out[start:at] = True
    return out if at else None


def repeats_a_part(unit: np.ndarray, ratio: float) -> bool:
    """Whether a unit turned by no more than half its length is itself but for tolerance() bases: then a shorter unit stands for it."""
    most = tolerance(len(unit), ratio)
    return any(int((unit != np.roll(unit, k)).sum()) <= most for k in range(1, len(unit) // 2 + 1))


def similar(a: np.ndarray, b: np.ndarray, ratio: float) -> bool:
    """Whether some rotation of the shorter unit aligns with the longer one.

    All rotations are aligned at once, within a band. A rotation is out as soon
    as the best score of a row is behind a perfect one by more than twice the
    tolerance.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    most = tolerance(n, ratio)
    if m - n > max(1, most):
        return False
    turned = np.stack([np.roll(a, -k) for k in range(n)])
    places = np.arange(m + 1)
    width = max(1, most)
    far = -4 * (n + m)
    row = np.repeat(np.where(places <= width, -places, far)[None], n, axis=0)
    alive = np.ones(n, bool)
    for i in range(1, n + 1):
        gain = np.where(turned[:, i - 1, None] == b[None], 1, -1)
        new = row - 1
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + gain)
        new = np.where(np.abs(places - i) <= width, new, far)
        new = np.maximum.accumulate(new + places, axis=1) - places  # a gap to the right costs one a place
        row = np.where(np.abs(places - i) <= width, new, far)
        alive &= i - row.max(axis=1) <= 2 * most
        if not alive.any():
            return False
    return True
