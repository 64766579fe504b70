"""Token counts of whole texts by a byte-level BPE file of the tokenizers library: lengths only, in balanced batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import mixed, prefix_hash, slices, span_hash, table, utf8

TOKENIZER = "byte_bpe_50k.json"
BATCH_BYTES = 1 << 16
LIMIT = 512
# Pieces up to this length are remembered by a worker, this many at most.
MEMORY_BYTES = 40
MEMORY_PIECES = 1 << 20

_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True
# First bytes of characters of two bytes from U+00C0 on, and of three bytes in blocks without white space.
_TWO = np.zeros(256, bool)
_TWO[0xC3:0xE0] = True
_THREE = np.zeros(256, bool)
_THREE[0xE4:0xF0] = True


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Positions of single blanks between two characters that surely are not white space.

    There the pre-tokenizer's pattern always ends one match and starts the next, with the blank as its first character,
    and no special string holds a blank. So the pieces between such cuts have together the tokens of the whole text.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    after, last = data[at + 1], data[at - 1]
    before = _PRINTABLE[last] | ((last >= 0x80) & (_TWO[data[at - 2]] | _THREE[data[np.maximum(at - 3, 0)]]) & (at >= 3))
    return at[before & (_PRINTABLE[after] | _TWO[after] | _THREE[after])]


_LOADED: dict[str, tuple[object, dict[int, int]]] = {}


def tokenizer(path: str) -> tuple[object, dict[int, int]]:
    """The library's tokenizer without truncation and padding, and what the worker remembers of short pieces."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _LOADED[path] = loaded, {}
    return _LOADED[path]


def _batches(pieces: list[str], limit: int) -> Iterator[list[str]]:
    """Batches of about `limit` characters each, so that none is much more work than another."""
    ends = np.cumsum([len(p) for p in pieces])
    at = 0
    while at < len(pieces):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield pieces[at:to]
        at = to


def count_tokens(data: np.ndarray, offsets: np.ndarray, path: str, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each row: the different pieces of all rows are encoded once, in batches balanced by bytes."""
    encode, memory = tokenizer(path)
    cuts = safe_cuts(data)
    starts = np.unique(np.concatenate([offsets[:-1], cuts]))
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    keys = mixed(span_hash(prefix_hash(data), starts, ends)) + (ends - starts).astype(np.uint64)
    distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
    names = distinct.tolist()
    counts = np.array([memory.get(k, -1) for k in names], np.int64)
    missing = np.flatnonzero(counts < 0)
    lengths = (ends - starts)[first[missing]]
    missing = missing[np.argsort(lengths, kind="stable")]
    if len(missing):
        raw, begin, end = data.tobytes(), starts[first[missing]].tolist(), ends[first[missing]].tolist()
        pieces = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(begin, end, strict=True)]
        found = [len(x) for batch in _batches(pieces, batch_bytes) for x in encode.encode_batch_fast(batch, add_special_tokens=False)]
        counts[missing] = found
        if len(memory) > MEMORY_PIECES:
            memory.clear()
        memory.update((names[i], n) for i, n, a, b in zip(missing.tolist(), found, begin, end, strict=True) if b - a <= MEMORY_BYTES)
    before = np.append(0, np.cumsum(counts[which]))
    return np.diff(before[np.searchsorted(starts, offsets)])


def _encoder(path: str, batch_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            counts = count_tokens(data, offsets, path, batch_bytes)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.diff(offsets)), pa.array(counts)], names=["key", "n_bytes", "n_tokens"])

    return run


def token_counts(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row: what the library gives for the whole text, no special tokens added.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys stay, one result row each; other
    columns are not read; an empty table gives no rows. Texts are cut at safe blanks (`safe_cuts`); a stretch without
    one is encoded whole. No shuffle: a row's work follows its bytes, and scan partitions are cut by bytes. The
    tokenizer file lies at the same path on every worker.
    """
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        _encoder(tokenizer_path, batch_bytes), f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
