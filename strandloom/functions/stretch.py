"""Alignment of one stretch of a read with units, from any scores at its begin.

Scores are those of kernel.Lanes: a match of a base gives 2, a place of a unit
passed over costs 1, all else nothing. A stretch maps scores of all cells at
its begin to those at its end; best sums add up over it, so the maps of
neighbouring stretches multiply as matrices do, with maximum for sum and sum
for product.
"""

from __future__ import annotations

import numpy as np

#: Far below all scores, and far enough between lanes that a running maximum stays in its lane.
NONE = -(1 << 40)
STEP = 1 << 43


class Cells:
    """The places of a read's units, side by side."""

    def __init__(self, units: list[np.ndarray]):
        size = np.array([len(u) for u in units])
        self.last = np.cumsum(size) - 1
        self.first = self.last - size + 1
        self.unit = np.repeat(np.arange(len(units)), size)
        bases = np.concatenate(units)
        self.count = len(bases)
        self.gain = np.stack([np.where(bases == b, 2, 0).astype(np.int64) for b in range(4)])
        self.ramp = np.arange(self.count, dtype=np.int64) + self.unit * STEP
        #: For each cell the first cell of its unit.
        self.head = self.first[self.unit]

    def step(self, state: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores after one more base of each row, those of pairing it, and sums whose running maximum tells gaps."""
        d = np.empty_like(state)
        d[:, 1:] = state[:, :-1]
        d[:, self.first] = state[:, self.last].max(axis=1)[:, None]
        d += self.gain[base]
        x = np.maximum(d, state) + self.ramp
        np.maximum.accumulate(x, axis=1, out=x)
        return x - self.ramp, d, x

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """Scores at the end of a stretch (columns) from each cell alone at its begin (rows)."""
        return self.matrices(codes[None])[0]

    def matrices(self, codes: np.ndarray) -> np.ndarray:
        """The matrix of each of several stretches of one length (rows of codes)."""
        state = np.full((self.count, self.count), NONE, np.int64)
        np.fill_diagonal(state, 0)
        state = np.tile(state, (len(codes), 1))
        for b in np.repeat(codes.T, self.count, axis=1):
            state = self.step(state, b)[0]
            np.maximum(state, NONE, out=state)
        return state.reshape(len(codes), self.count, self.count)

    def traced(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, list[int], list[list[tuple[int, int]]]]:
        """From scores at the begin: scores at the end, and for each cell there the cell at the begin that its best path comes from, and the path's runs (bases, unit).

        A base with its place comes before a place without a base, and that
        before a base without a place; of units that end equally well the last
        is taken.
        """
        return self.traced_all(codes[None], begin[None])[0]

    def traced_all(self, codes: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, list[int], list[list[tuple[int, int]]]]]:
        """What traced gives, for several stretches of one length."""
        (count, n), width = codes.shape, self.count
        other, gap = np.zeros((count, n, width), bool), np.zeros((count, n, width), bool)
        owner = np.zeros((count, n), np.int64)
        state = begin
        for i, b in enumerate(codes.T):
            tips = state[:, self.last]
            owner[:, i] = tips.shape[1] - 1 - np.argmax(tips[:, ::-1], axis=1)
            state, d, x = self.step(state, b)
            np.not_equal(state, d, out=other[:, i])
            np.equal(x[:, 1:], x[:, :-1], out=gap[:, i, 1:])
        return [(state[k], *self.paths(other[k], gap[k], owner[k])) for k in range(count)]

    def paths(self, other: np.ndarray, gap: np.ndarray, owner: np.ndarray) -> tuple[list[int], list[list[tuple[int, int]]]]:
        """Where the best path to each cell comes from, and its runs, by the noted moves."""
        n, width = other.shape
        steps, gaps, tails, heads, unit = other.tobytes(), gap.tobytes(), self.last[owner].tolist(), set(self.first.tolist()), self.unit.tolist()
        come, runs = [], []
        for cell in range(width):
            own: list[list[int]] = []
            i, at = n - 1, (n - 1) * width
            while i >= 0:
                here = unit[cell]
                if not steps[at + cell]:
                    cell = tails[i] if cell in heads else cell - 1
                elif gaps[at + cell]:
                    cell -= 1
                    continue
                if own and own[-1][1] == here:
                    own[-1][0] += 1
                else:
                    own.append([1, here])
                i -= 1
                at -= width
            come.append(cell)
            runs.append([(m, u) for m, u in reversed(own)])
        return come, runs
