"""Polynomial hashes of all spans of a byte buffer, and minimisers over them."""

from __future__ import annotations

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INDEX_BITS = 20
_LOW = 4096
_tables: dict[tuple[int, bool, int], tuple[np.ndarray, np.ndarray]] = {}


def _letters(which: int) -> np.ndarray:
    return np.random.default_rng(1234 + which).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _parts(which: int, inverse: bool, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to _LOW - 1 of a base, or of its inverse modulo 2**64, and those of its _LOW-th power for places below n; their products are all powers."""
    high = 1 << max(8, ((n >> 12) + 1).bit_length())
    key = (which, inverse, high)
    if key not in _tables:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        row = lambda b, m: np.concatenate([[np.uint64(1)], np.cumprod(np.full(m - 1, b, np.uint64))])
        _tables[key] = row(base, _LOW), row(pow(base, _LOW, 1 << 64), high)
    return _tables[key]


def powers(which: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of a base."""
    low, high = _parts(which, False, n)
    return (high[: -(-n // _LOW), None] * low).ravel()[:n]


def inverse_powers(which: int, at: np.ndarray, n: int) -> np.ndarray:
    """Powers of the inverse of a base at places below n."""
    low, high = _parts(which, True, n)
    return high[at >> 12] * low[at & (_LOW - 1)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Spans:
    """Hashes of buffer[start:end] for arrays of starts and ends."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.which, self.n = which, len(data) + 1
        terms = _letters(which)[data]
        terms *= powers(which, len(data))
        self.sums = np.zeros(self.n, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * inverse_powers(self.which, start, self.n) + (end - start).astype(np.uint64))


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    span = 1
    while 2 * span <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def minimisers(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Value and leftmost position of the least hash in every window of `width` hashes."""
    if len(hashes) > 1 << INDEX_BITS:
        raise ValueError(f"{len(hashes)} hashes, more than {1 << INDEX_BITS} places")
    index = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << INDEX_BITS) - 1)
    least = window_min(hashes & ~low | index, width)
    return (least >> np.uint64(INDEX_BITS)).astype(np.int64), (least & low).astype(np.int64)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs in which all keys stay the same."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.zeros(n - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    start = np.concatenate([[0], np.flatnonzero(change) + 1])
    return start, np.diff(np.concatenate([start, [n]]))
