"""CRC-32 of many spans of one buffer at once, by a table of what a byte adds at each distance from its span's end.

The register of CRC-32 is linear over XOR: started at zero, its value after a span is the XOR of one term for each byte,
which depends on the byte and on its distance from the end only. The usual start and final values add a term that
depends on the span's length only.
"""

from __future__ import annotations

import numpy as np

# Fixed value: the reflected polynomial of CRC-32 (zlib, Parquet, PNG).
POLYNOMIAL = 0xEDB88320
# Distances that the table holds (256 KB); a longer span is folded from blocks of this many bytes.
REACH = 256
# Blocks of long spans looked up at one time.
CHUNK = 8192


def _byte_terms() -> np.ndarray:
    """What each byte adds as the last of its span."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & np.uint32(1), (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1)).astype(np.uint32)
    return out


LAST = _byte_terms()


def _one_further(values: np.ndarray) -> np.ndarray:
    """The register after one more zero byte."""
    return (values >> np.uint32(8)) ^ LAST[values & np.uint32(255)]


def _positions() -> np.ndarray:
    table = np.empty((REACH, 256), np.uint32)
    table[0] = LAST
    for d in range(1, REACH):
        table[d] = _one_further(table[d - 1])
    return table.ravel()


# POSITIONS[256 * d + b]: what byte b adds, d bytes before the last one.
POSITIONS = _positions()


class Shift:
    """The register after REACH * 2^j more zero bytes: four lookups, one for each byte of the register."""

    _tables: list[np.ndarray] = []

    @classmethod
    def table(cls, j: int) -> np.ndarray:
        while len(cls._tables) <= j:
            if not cls._tables:
                values = (np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
                for _ in range(REACH):
                    values = _one_further(values)
                cls._tables.append(values)
            else:
                cls._tables.append(cls._apply(cls._tables[-1], cls._tables[-1]))
        return cls._tables[j]

    @staticmethod
    def _apply(table: np.ndarray, values: np.ndarray) -> np.ndarray:
        mask = np.uint32(255)
        return table[0][values & mask] ^ table[1][(values >> np.uint32(8)) & mask] ^ table[2][(values >> np.uint32(16)) & mask] ^ table[3][values >> np.uint32(24)]

    @classmethod
    def far(cls, values: np.ndarray, j: int) -> np.ndarray:
        return cls._apply(cls.table(j), values)


def _length_constants() -> np.ndarray:
    """CRC-32 of n zero bytes for n up to REACH."""
    out = np.empty(REACH + 1, np.uint32)
    register = np.array([0xFFFFFFFF], np.uint32)
    for n in range(REACH + 1):
        out[n] = register[0] ^ np.uint32(0xFFFFFFFF)
        register = _one_further(register)
    return out


CONSTANTS = _length_constants()


def _constants(sizes: np.ndarray) -> np.ndarray:
    out = CONSTANTS[sizes % REACH]
    blocks = sizes // REACH
    far = np.flatnonzero(blocks)
    if len(far):
        register = out[far] ^ np.uint32(0xFFFFFFFF)
        for j in range(int(blocks.max()).bit_length()):
            odd = (blocks[far] >> j) & 1 == 1
            register[odd] = Shift.far(register[odd], j)
        out[far] = register ^ np.uint32(0xFFFFFFFF)
    return out


def _terms(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XOR of the bytes' terms for spans of 1 to REACH bytes."""
    ends = np.cumsum(sizes)
    at = np.arange(int(ends[-1])) if len(ends) else np.zeros(0, np.int64)
    first = ends - sizes
    before_end = np.repeat(ends, sizes) - 1 - at
    source = at + np.repeat(starts - first, sizes)
    return np.bitwise_xor.reduceat(POSITIONS[(before_end << 8) + data[source]], first)


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for every span; spans may overlap, an empty one gives 0."""
    starts, sizes = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - np.asarray(starts, np.int64)
    out = _constants(sizes)
    short = np.flatnonzero((sizes > 0) & (sizes <= REACH))
    if len(short):
        out[short] ^= _terms(data, starts[short], sizes[short])
    long = np.flatnonzero(sizes > REACH)
    if len(long):
        # Blocks are counted from a span's end; only the block farthest from it may be shorter.
        blocks = -(-sizes[long] // REACH)
        owner = np.repeat(np.arange(len(long)), blocks)
        to_end = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(owner))
        stop = np.repeat(np.asarray(ends, np.int64)[long], blocks) - to_end * REACH
        start = np.maximum(stop - REACH, np.repeat(starts[long], blocks))
        value = np.concatenate([_terms(data, start[i : i + CHUNK], (stop - start)[i : i + CHUNK]) for i in range(0, len(start), CHUNK)])
        j = 0
        while to_end.any():
            far = to_end & 1 == 1
            value[far] = Shift.far(value[far], j)
            to_end >>= 1
            heads = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (to_end[1:] != to_end[:-1])))
            value, owner, to_end = np.bitwise_xor.reduceat(value, heads), owner[heads], to_end[heads]
            j += 1
        out[long] ^= value
    return out
