"""Shared by the operators: tables, bounded slices of Arrow text, words of UTF-8 bytes as arrays, folders of one run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.session import run_folder

# Bytes of text that a task holds as arrays at one time; a longer single text makes a slice of its own.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: later passes plan on a leaf, and a lost executor costs tasks only."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """`df` with `pos`, which grows with `order` over the whole table: the number of a range times 2^33 plus the place in it.

    Ranges are cut by a sample of the rows, so rows that differ in `order` are spread over all tasks whatever their keys. Written once.
    """
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at, base = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at, base = to, int(ends[to - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


# Odd multiplier of the polynomial hash (modulo 2^64) and the seed of its byte values.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.RandomState(20240611).randint(1, 2**63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table_of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table_of(BASE), table_of(BASE_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to n; two sizes are kept, so that a rare long text doesn't push out the usual one."""
    size = SLICE_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = BASE^i * hash(data[i:j])."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    values = BYTE_VALUES[data]
    values *= up[: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * down[starts]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer: all bits of a 64-bit value depend on all others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _fold_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[ord("A") : ord("Z") + 1] += 32
    return fold


FOLD_ASCII = _fold_table()
# Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z, and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True
# Bytes of [^\x20\x09-\x0D].
NONSPACE_BYTES = np.ones(256, bool)
NONSPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, none across rows, and the number of words before each row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, bool)
    stops[1:] = inside[:-1] & ~inside[1:]
    cut = edges[edges > 0]
    stops[cut] |= inside[cut - 1]
    ends = np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)
