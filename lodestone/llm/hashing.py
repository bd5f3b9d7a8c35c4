"""Vectorised 64-bit hashes of byte and word ranges."""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


#: A random value for each byte.
BYTES = mixed(np.arange(1, 257, dtype="u8") * np.uint64(_ODD[0]))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were needed so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, "u8")

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, m, 1 << 64))])
        return self.up[:n], self.down[:n]


#: For ranges of letters within words, and of words within texts.
LETTERS, WORDS = _Powers(_ODD[1]), _Powers(_ODD[2])


def range_hashes(values: np.ndarray, powers: _Powers, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the ranges values[start:stop], by differences of one polynomial prefix sum."""
    up, down = powers.of(len(values) + 1)
    prefix = np.zeros(len(values) + 1, "u8")
    np.cumsum(values * up[:-1], out=prefix[1:])
    return mixed((prefix[stop] - prefix[start]) * down[start])


def word_hashes(words: list[bytes]) -> np.ndarray:
    length = np.fromiter(map(len, words), "i8", len(words))
    stop = np.cumsum(length)
    return range_hashes(BYTES[np.frombuffer(b"".join(words), "u1")], LETTERS, stop - length, stop)
