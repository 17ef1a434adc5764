"""Array operations used inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed one-to-one map)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers[:n]


_SIGNS = mix(np.arange(1, 65537, dtype=np.uint64))


def segment_hash(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of ``codes``; segments begin at ``starts`` (ascending, the first 0) and cover all."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = np.diff(np.append(starts, len(codes)))
    at = np.arange(len(codes), dtype=np.int64) - np.repeat(starts, lengths)
    signs = _SIGNS[codes if codes.itemsize <= 2 else codes & 0xFFFF]
    if codes.itemsize > 2 and len(codes) and codes.max() > 0xFFFF:
        signs = signs + mix(codes >> np.uint32(16)) * (codes > 0xFFFF)
    signs = signs * powers(int(lengths.max()))[at]
    return mix(np.add.reduceat(signs, starts) + mix(lengths.astype(np.uint64)))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (count[0] of them), first[1], .."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(first - (ends - count), count)
