"""Hashes of many substrings at once, by prefix sums over a polynomial."""
from __future__ import annotations

from functools import lru_cache

import numpy as np

# Two odd bases; a substring's pair of hashes has 128 bits.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        x = np.full(size, b, np.uint64)
        x[0] = 1
        return np.cumprod(x)
    return run(base), run(pow(base, -1, 1 << 64))


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i up to at least ``size``."""
    return _powers(base, 1 << max(12, int(size).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def hashes(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings start..end of the sequence that ``sums`` are of."""
    _, down = powers(base, len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
