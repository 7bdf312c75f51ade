"""Many texts as one numpy array of code points, for operators that work on all of them at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SIZE = 0x110000
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (where that is one code point), and if it is a letter."""
    low = np.arange(SIZE, dtype=np.uint32)
    alpha = np.zeros(SIZE, dtype=bool)
    for i in range(SIZE):
        c = chr(i)
        if c.isalpha():
            alpha[i] = True
            lc = c.lower()
            if len(lc) == 1:
                low[i] = ord(lc)
    return low, alpha


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


@lru_cache(1)
def _trim():
    """The C library's way to give free memory back, if it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small parts; what the allocators hold beyond them goes back at once, as
    two workers share an executor's memory with its JVM and stay for later stages."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
            _trim()(0)
        pa.default_memory_pool().release_unused()


def blocks(texts: Iterable[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, about ``most`` code points together (a longer text stands alone)."""
    at, held, n = 0, [], 0
    for i, t in enumerate(texts):
        if held and n + len(t) > most:
            yield at, held
            at, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield at, held


_STEP = 1 << 16


def _raised(base: int, n: int) -> np.ndarray:
    a = np.full(n, base, dtype=np.uint64)
    a[0] = 1
    return np.multiply.accumulate(a)


@lru_cache(1)
def _small() -> tuple[np.ndarray, np.ndarray]:
    return _raised(int(BASE), _STEP), _raised(pow(int(BASE), -1, 1 << 64), _STEP)


@lru_cache(1)
def _powers(steps: int) -> tuple[np.ndarray, np.ndarray]:
    both = ((int(BASE), _small()[0]), (pow(int(BASE), -1, 1 << 64), _small()[1]))
    return tuple((_raised(pow(b, _STEP, 1 << 64), steps)[:, None] * small).ravel() for b, small in both)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i < n at least; of long tables only one is kept."""
    return _small() if n <= _STEP else _powers(-(-n // _STEP))


class Hashes:
    """Hashes of any substring of an array: H(s, e) depends on the symbols s..e-1 alone."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        self.pw, self.inv = powers(n)
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.pw[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inv[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
