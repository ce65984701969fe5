"""Polynomial prefix hashes of bytes, modulo 2**64, and what is made from them."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses
_POWERS = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n, kept and grown."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        for at, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size + 1, base, U)
            steps[0] = 1
            _POWERS[at] = np.cumprod(steps, dtype=U)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Prefixes:
    """Hashes of any substring of some bytes in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, length: int) -> np.ndarray:
        """The hash of each substring of one length."""
        n = max(len(self.data) - length + 1, 0)
        return (self.sums[length : length + n] - self.sums[:n]) * self.down[:n]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the substrings of ``length`` at a and b are equal, byte for byte."""
    if length < 8 or len(data) < 8:
        at = np.arange(length)
        return (data[a[:, None] + at] == data[b[:, None] + at]).all(axis=1)
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    same = np.ones(len(a), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        same &= words[a + at] == words[b + at]
    return same
