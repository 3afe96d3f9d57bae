"""Rolling hashes over bytes and sliding minima, vectorised."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            factors = np.ones((2, size + 1), dtype=np.uint64)
            factors[0, 1:], factors[1, 1:] = np.uint64(_BASE), np.uint64(_INVERSE)
            self.up, self.down = np.cumprod(factors, axis=1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of table[byte] * base**place; spans() turns differences into hashes."""
        self.upto(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes from starts to ends, the same wherever they stand."""
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mix((prefix[width:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row, by minima within blocks from both ends."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    shaped = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(shaped, axis=1).ravel()
    backward = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])
