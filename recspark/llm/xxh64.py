"""XXH64 of many spans of one buffer at once: the published algorithm, lane by lane over arrays."""

from __future__ import annotations

import numpy as np

U = np.uint64
# The primes of the XXH64 specification.
P1, P2, P3, P4, P5 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotated(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """Hash of data[start:end] for every span, as unsigned 64-bit integers."""
    raw = np.concatenate([data, np.zeros(40, np.uint8)])
    # Little-endian words at every byte position.
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    halves = np.ndarray((len(raw) - 3,), "<u4", raw, strides=(1,))
    size = ends - starts
    at = starts.copy()
    with np.errstate(over="ignore"):
        h = np.full(len(starts), U(seed) + P5, np.uint64)
        rows = np.flatnonzero(size >= 32)
        if len(rows):
            start = U(seed)
            acc = [np.full(len(rows), v, np.uint64) for v in (start + P1 + P2, start + P2, start, start - P1)]
            live = np.arange(len(rows))
            while len(live):
                pos = at[rows[live]]
                for i in range(4):
                    acc[i][live] = _round(acc[i][live], words[pos + 8 * i])
                at[rows[live]] += 32
                live = live[at[rows[live]] + 32 <= ends[rows[live]]]
            merged = _rotated(acc[0], 1) + _rotated(acc[1], 7) + _rotated(acc[2], 12) + _rotated(acc[3], 18)
            for lane in acc:
                merged = (merged ^ _round(np.zeros_like(lane), lane)) * P1 + P4
            h[rows] = merged
        h += size.astype(np.uint64)
        for _ in range(3):
            rows = np.flatnonzero(at + 8 <= ends)
            h[rows] = _rotated(h[rows] ^ _round(np.zeros(len(rows), np.uint64), words[at[rows]]), 27) * P1 + P4
            at[rows] += 8
        rows = np.flatnonzero(at + 4 <= ends)
        h[rows] = _rotated(h[rows] ^ halves[at[rows]].astype(np.uint64) * P1, 23) * P2 + P3
        at[rows] += 4
        for _ in range(3):
            rows = np.flatnonzero(at < ends)
            h[rows] = _rotated(h[rows] ^ raw[at[rows]].astype(np.uint64) * P5, 11) * P1
            at[rows] += 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h
