"""XXH64 of many short stretches of one byte buffer at once."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
#: The primes of XXH64.
P1, P2, P3, P4, P5 = U(11400714785074694791), U(14029467366897019727), U(1609587929392839161), U(9650029242287828579), U(2870177450012600261)


def _rotl(x, r):
    return (x << U(r)) | (x >> U(64 - r))


def xxh64_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of data[starts[i] : starts[i] + lengths[i]] for all i; stretches of 32 bytes or more go to the library one by one."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))
    halves = np.ndarray((len(data) + 8,), "<u4", padded, 0, (1,))
    out = np.empty(len(starts), np.uint64)
    long_ = np.flatnonzero(lengths >= 32)
    if len(long_):
        raw = data.tobytes()
        out[long_] = [xxhash.xxh64_intdigest(raw[a : a + n], seed) for a, n in zip(starts[long_].tolist(), lengths[long_].tolist(), strict=True)]
    rows = np.flatnonzero(lengths < 32)
    if not len(rows):
        return out
    rows = rows[np.argsort(lengths[rows], kind="stable")]
    size, at = lengths[rows], starts[rows].copy()
    h = U(seed) + P5 + size.astype(U)
    for k in range(1, 4):  # whole words of 8 bytes
        a = np.searchsorted(size, 8 * k)
        if a == len(size):
            break
        h[a:] = _rotl(h[a:] ^ (_rotl(words[at[a:]] * P2, 31) * P1), 27) * P1 + P4
        at[a:] += 8
    left = size & 7
    four = np.flatnonzero(left >= 4)
    if len(four):
        h[four] = _rotl(h[four] ^ (halves[at[four]].astype(U) * P1), 23) * P2 + P3
        at[four] += 4
    left = left & 3
    for k in range(3):
        one = np.flatnonzero(left > k)
        if not len(one):
            break
        h[one] = _rotl(h[one] ^ (padded[at[one]].astype(U) * P5), 11) * P1
        at[one] += 1
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    h ^= h >> U(32)
    out[rows] = h
    return out
