"""Two-stage suffix sorting of short texts in one buffer, and the common prefixes of neighbours.

A suffix is here the bytes from a position to the end of its text, compared over its first `depth` bytes. Suffixes that are
smaller than their successor (type S) are sorted directly; the others (type L) follow from them by one scan over the buckets
of first bytes, since a type L suffix is its first byte before a smaller suffix.
"""

from __future__ import annotations

import numpy as np


def suffix_types(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """True where a suffix is of type S: its first byte other than the first is larger.

    Only the first `depth` bytes count, so that equal prefixes always get equal types; without another byte in them, S.
    """
    n = len(data)
    changes = np.zeros(n, bool)
    changes[:-1] = data[1:] != data[:-1]
    changes[ends - 1] = True
    stops = np.flatnonzero(changes)
    stop = np.repeat(stops, np.diff(stops, prepend=-1))  # last byte of the run that each position lies in
    last = np.zeros(n, bool)
    last[ends - 1] = True
    after = data[np.minimum(stop + 1, n - 1)]
    unsettled = last[stop] | (stop + 1 - np.arange(n) >= depth)
    return unsettled | (after > data)


def suffix_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the first counts[i] suffixes of each text data[starts[i]:ends[i]], in order of their first `depth` bytes.

    Positions that come after them in their text only to induce from are sorted too and left out at the end.
    """
    small = suffix_types(data, ends, depth)
    wanted = np.zeros(len(data) + 1, np.int32)
    np.add.at(wanted, starts, 1)
    np.add.at(wanted, starts + counts, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    # From the last wanted suffix of a text on, up to the first of type S.
    s_at = np.flatnonzero(small)
    until = s_at[np.searchsorted(s_at, starts + counts - 1)]
    used = np.zeros(len(data) + 1, np.int32)
    np.add.at(used, starts, 1)
    np.add.at(used, until + 1, -1)
    used = np.cumsum(used[:-1]) > 0

    # First stage: type S, directly.
    direct = np.flatnonzero(used & small)
    raw = data.tobytes()
    text_end = ends[np.searchsorted(ends, direct, "right")]
    keys = [raw[a:b] for a, b in zip(direct.tolist(), np.minimum(direct + depth, text_end).tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]

    # Second stage: scan the buckets in order; each finished bucket hands its type L predecessors on to larger ones.
    first = data[direct]
    cut = np.searchsorted(first, np.arange(257))
    inside = np.zeros(len(data), bool)  # is the position before this one used and in the same text
    inside[1:] = used[:-1]
    inside[starts] = False
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for byte in range(256):
        large = waiting[byte]
        fresh = np.concatenate(large) if large else np.zeros(0, np.int64)
        parts = [fresh]
        while len(fresh):  # runs of this byte that go down in the end: each longer one follows from the shorter one
            before = fresh[inside[fresh]] - 1
            fresh = before[(data[before] == byte) & ~small[before]]
            parts.append(fresh)
        bucket = np.concatenate([*parts, direct[cut[byte] : cut[byte + 1]]])
        if not len(bucket):
            continue
        done.append(bucket)
        before = bucket[inside[bucket]] - 1
        before = before[(data[before] > byte) & ~small[before]]
        to = data[before]
        order = np.argsort(to, kind="stable")
        before, to = before[order], to[order]
        for piece in np.split(before, np.flatnonzero(to[1:] != to[:-1]) + 1):
            if len(piece):
                waiting[data[piece[0]]].append(piece)
    out = np.concatenate(done) if done else np.zeros(0, np.int64)
    return out[wanted[out]]


def common_prefixes(data: np.ndarray, order: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, `depth` at most; 0 for the first."""
    if len(order) < 2:
        return np.zeros(len(order), np.int64)
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    text_end = ends[np.searchsorted(ends, order, "right")]
    room = np.minimum(np.minimum(text_end - order, depth)[1:], np.minimum(text_end - order, depth)[:-1])
    shared = room.copy()
    live, a, b = np.arange(len(room)), order[:-1], order[1:]
    at = 0
    while len(live):
        live = live[room[live] > at]
        x = words[a[live] + at] ^ words[b[live] + at]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))  # lowest bit that differs
        same = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        shared[live[differ]] = np.minimum(room[live[differ]], at + same)
        live = live[~differ]
        at += 8
    return np.append(0, shared)
