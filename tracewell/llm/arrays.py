"""Small numpy helpers for work inside tasks: word hashes, rolling windows, packed arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words met last; ``keep`` bounds the memory."""

    def __init__(self, keep: int = 200_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes of all windows of ``k`` items, by prefix sums modulo 2**64.

    With S(i) the sum of x(j) * B**-j over j < i, the hash of the window at i is (S(i + k) - S(i)) * B**(i + k - 1).
    """

    def __init__(self, k: int):
        self.k = k
        self.power = self.inverse = np.ones(1, np.uint64)

    def _extend(self, n: int) -> None:
        def powers(base: int) -> np.ndarray:
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            return np.multiply.accumulate(factors)

        self.power, self.inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def __call__(self, items: np.ndarray) -> np.ndarray:
        n = len(items)
        if n < self.k:
            return np.empty(0, np.uint64)
        if n > len(self.power):
            self._extend(max(n, 2 * len(self.power)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(items * self.inverse[:n], out=sums[1:])
        return mix64((sums[self.k :] - sums[: n - self.k + 1]) * self.power[self.k - 1 : n])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack(a: np.ndarray) -> bytes:
    """An array as byte planes: equal high bytes stand together and compress to nothing in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def steps(a: np.ndarray) -> bytes:
    """An ascending array by its differences, packed: the smaller they are, the more planes compress to nothing."""
    out = a.copy()
    out[1:] -= a[:-1]
    return pack(out)


def from_steps(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum up to ``most``, or single ones above it."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
