"""Hashes of byte ranges by prefix sums, and positions of local minima; NumPy on one piece of text.

A byte b at position j adds ``table[b] * base**j`` modulo 2**64; a range's hash is the difference
of two prefix sums, shifted to position 0.  Equal bytes give equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

#: Longest piece that is hashed at once; positions fit in 20 bits.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES = np.random.default_rng(20240607).integers(0, 1 << 63, (4, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, kept between calls."""
    if base not in _powers or len(_powers[base]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = np.full(size, np.uint64(base))
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Ranges:
    """Hashes of ranges of one piece of bytes."""

    def __init__(self, data: np.ndarray, table: int = 0):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLES[table][data] * _power(_INVERSE, n), out=self.sums[1:])
        self.shift = _power(_BASE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.shift[start])

    def all(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.shift[: len(self.sums) - length])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value in each run of ``width``, the first of equals.

    Compares the upper 44 bits, then the position: what is chosen depends on the values alone.
    """
    n = len(values) - width + 1
    mask = np.uint64(PIECE - 1)
    keys = np.full(-(-len(values) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    keys[: len(values)] = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    blocks = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & mask).astype(np.int64)
