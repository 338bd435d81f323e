"""Hashes of the words and byte strings of many texts at once, on the buffers that Arrow hands over.

The hash of bytes s..e is (C[e] - C[s]) * B**-s modulo 2**64, with C the running sum of T[byte] * B**position: every
substring's hash costs two lookups, whatever its length. T holds random numbers and results are mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.random.default_rng(20_240_229)
_T = _R.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_B, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    p = _powers.get(base, np.ones(1, np.uint64))
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 2**64))])
    _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Substring hashes of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_T[data] * _power(_B, n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _power(_BACK, len(self.sums))[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of a string column in runs of about ``most`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each document and their number at the end); A-Z as a-z if ``lower``."""
    if lower:
        data = _LOWER[data]
    ink = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    after[inner[inner > 0] - 1] = False
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return Hashed(data)(start, end), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its ``width``-word runs; the whole sequence if it has fewer words, none if none."""
    grown = hashes.copy()
    for k in range(1, width):
        grown = mix(grown[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[k:]) if len(grown) > 1 else grown[:0]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grown[a : b - width + 1]))
        else:
            h = hashes[a:b][:1]
            for x in hashes[a + 1 : b]:
                h = mix(h * np.uint64(0x9FB21C651E98DF25) + np.array([x]))
            out.append(h + np.uint64(b - a) if len(h) else h)
    return out
