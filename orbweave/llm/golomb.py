"""Golomb-coded sets: sorted integers as compressed gaps, in blocks that decode on their own."""

from __future__ import annotations

import numpy as np

BLOCK = 128


class GolombSet:
    """A fixed set of distinct integers below `universe`.

    The first value of each block of 128 stands in an index; the other values are gaps, cut into a unary
    quotient and a remainder of `r` bits (Rice's form of the Golomb code). A probe decodes only the blocks
    its values can lie in.
    """

    def __init__(self, values: np.ndarray, universe: int, level: int = 0):
        v = np.ascontiguousarray(values, dtype=np.uint64)
        self.count, self.universe, self.level = len(v), universe, level
        self.heads = v[::BLOCK].copy()
        mean_gap = universe / max(1, len(v))
        self.r = max(0, int(np.floor(np.log2(max(1.0, mean_gap * np.log(2))))))
        inner = np.ones(len(v), dtype=bool)
        inner[::BLOCK] = False
        gaps = np.diff(v, prepend=v[:1])[inner]
        block = (np.arange(len(v)) // BLOCK)[inner]
        q = (gaps >> np.uint64(self.r)).astype(np.int64)
        ends = np.cumsum(q + 1)
        sizes = np.bincount(block, weights=q + 1, minlength=len(self.heads)).astype(np.int64)
        starts_in = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        room = (sizes + 7) // 8
        self.offsets = np.concatenate([[0], np.cumsum(room)]).astype(np.int64)
        bits = np.zeros(int(self.offsets[-1]) * 8, dtype=np.uint8)
        if len(gaps):
            bits[self.offsets[block] * 8 + ends - starts_in[block] - 1] = 1
        self.unary = np.packbits(bits)
        rest = gaps & np.uint64((1 << self.r) - 1)
        shifts = np.arange(self.r - 1, -1, -1, dtype=np.uint64)
        self.rest = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel())

    @property
    def bits(self) -> int:
        """Bits held: both streams, the block heads and the block offsets."""
        return 8 * (len(self.unary) + len(self.rest) + self.heads.nbytes + self.offsets.nbytes)

    def block(self, k: int) -> np.ndarray:
        """The values of one block."""
        ones = np.flatnonzero(np.unpackbits(self.unary[self.offsets[k] : self.offsets[k + 1]]))
        q = np.diff(ones, prepend=-1) - 1
        n, per = len(q), BLOCK - 1
        if self.r and n:
            first = k * per * self.r
            at, end = first // 8, (first + n * self.r + 7) // 8
            raw = np.unpackbits(self.rest[at:end])[first - 8 * at :][: n * self.r].reshape(n, self.r)
            low = raw @ (np.int64(1) << np.arange(self.r - 1, -1, -1, dtype=np.int64))
        else:
            low = np.zeros(n, dtype=np.int64)
        gaps = (q.astype(np.uint64) << np.uint64(self.r)) + low.astype(np.uint64)
        return self.heads[k] + np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(gaps, dtype=np.uint64)])

    def values(self) -> np.ndarray:
        """All values in order."""
        return np.concatenate([self.block(k) for k in range(len(self.heads))] or [np.empty(0, dtype=np.uint64)])

    def contains(self, probes: np.ndarray) -> np.ndarray:
        """Which of the probes are in the set."""
        x = np.ascontiguousarray(probes, dtype=np.uint64)
        if not self.count or not len(x):
            return np.zeros(len(x), dtype=bool)
        at = np.searchsorted(self.heads, x, side="right") - 1
        wanted = np.unique(at[at >= 0])
        held = np.concatenate([self.block(k) for k in wanted] or [np.empty(0, dtype=np.uint64)])
        where = np.searchsorted(held, x)
        inside = where < len(held)
        out = np.zeros(len(x), dtype=bool)
        out[inside] = held[where[inside]] == x[inside]
        return out


def add(levels: list[GolombSet], values: np.ndarray, universe: int) -> None:
    """Add sorted distinct values as a set of their own; equal levels merge, so few sets stay to be probed."""
    levels.append(GolombSet(values, universe))
    while len(levels) > 1 and levels[-1].level >= levels[-2].level:
        b, a = levels.pop(), levels.pop()
        levels.append(GolombSet(np.union1d(a.values(), b.values()), universe, a.level + 1))
