"""XXH64 of many byte ranges at once, in numpy (the public xxHash specification)."""

from __future__ import annotations

import numpy as np
import xxhash

#: FIXED VALUES: the five primes of XXH64
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)

#: groups of equal length smaller than this are hashed one by one
_FEW = 24


def _rot(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * P2, 31) * P1


def _same_length(u8: np.ndarray, u32: np.ndarray, u64: np.ndarray, s: np.ndarray, n: int, seed: int) -> np.ndarray:
    zero, k = np.zeros(len(s), np.uint64), 0
    if n >= 32:
        acc = [zero + np.uint64((seed + int(P1) + int(P2)) & (1 << 64) - 1), zero + np.uint64((seed + int(P2)) & (1 << 64) - 1),
               zero + np.uint64(seed), zero + np.uint64((seed - int(P1)) & (1 << 64) - 1)]
        while k + 32 <= n:
            for j in range(4):
                acc[j] = _round(acc[j], u64[s + (k + 8 * j)])
            k += 32
        h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for j in range(4):
            h = (h ^ _round(zero, acc[j])) * P1 + P4
    else:
        h = zero + np.uint64((seed + int(P5)) & (1 << 64) - 1)
    h += np.uint64(n)
    while k + 8 <= n:
        h = _rot(h ^ _round(zero, u64[s + k]), 27) * P1 + P4
        k += 8
    if k + 4 <= n:
        h = _rot(h ^ (u32[s + k].astype(np.uint64) * P1), 23) * P2 + P3
        k += 4
    while k < n:
        h = _rot(h ^ (u8[s + k].astype(np.uint64) * P5), 11) * P1
        k += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[starts[i]:ends[i]]`` for every i; ranges of one length are hashed together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    u32 = np.ndarray((len(data) + 1,), "<u4", buf, strides=(1,))
    u64 = np.ndarray((len(data) + 1,), "<u8", buf, strides=(1,))
    length = ends - starts
    order = np.argsort(np.minimum(length, 65535).astype(np.uint16), kind="stable")
    sizes = length[order]
    cuts = np.flatnonzero(np.diff(np.minimum(sizes, 65535))) + 1
    raw = memoryview(buf)
    for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(order))):
        pick, n = order[lo:hi], int(sizes[lo])
        if hi - lo < _FEW or n >= 1024:
            out[pick] = [xxhash.xxh64_intdigest(raw[s:e], seed) for s, e in zip(starts[pick].tolist(), ends[pick].tolist())]
        else:
            out[pick] = _same_length(buf, u32, u64, starts[pick], n, seed)
    return out
