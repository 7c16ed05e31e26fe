"""Hashes of byte ranges in NumPy: 64-bit polynomials over a table of random words, from running sums."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BASE = [int(x) | 1 for x in _RNG.integers(1 << 40, 1 << 63, 2)]
_TABLE = _RNG.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, (2, 256), dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the two hash bases and of their inverses, as long as the longest piece so far."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = [], []
            for b in _BASE:
                for out, x in ((self.up, b), (self.down, pow(b, -1, 1 << 64))):
                    steps = np.full(self.n, x, np.uint64)
                    steps[0] = 1
                    out.append(np.cumprod(steps, dtype=np.uint64))

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        self.upto(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[which][data] * self.up[which][: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """Hashes of data[start:end]."""
        return mix((sums[end] - sums[start]) * self.down[which][start])
