"""Benchmark decontamination: suffix arrays of training words, every benchmark suffix found in them by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import FOLD_ASCII, SLICE_BYTES, WORD_BYTES, mixed, prefix_hash, slices, span_hash, table, utf8, word_spans

WINDOW = 10
# Words of benchmark text that are broadcast and searched at one time; a larger benchmark takes several passes.
BLOCK_WORDS = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all rows, and the number of words before each row."""
    folded = FOLD_ASCII[data]
    starts, ends, before = word_spans(folded, offsets, WORD_BYTES)
    return mixed(span_hash(prefix_hash(folded), starts, ends)), before


@dataclass(frozen=True)
class BenchmarkBlock:
    """Benchmark items as word ranks. Rank 0 is any word that the block doesn't have."""

    vocabulary: np.ndarray  # sorted word hashes; rank is the place from 1 on
    ranks: np.ndarray  # words of all items, one 0 after each item
    suffixes: np.ndarray  # starts of the different windows
    lengths: np.ndarray  # words of each window
    names: list[str | None]  # of the items
    first_owner: np.ndarray  # place in the next two of each window's first owner, and their number at the end
    owner: np.ndarray  # number of an item that has the window
    owner_at: np.ndarray  # where it has it first
    maybe: np.ndarray  # which low hash bits the vocabulary has


FILTER_BITS = 20


def index_block(items: list[tuple[str | None, np.ndarray]], window: int = WINDOW) -> BenchmarkBlock:
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w in items)]))
    names = sorted({name for name, _ in items}, key=lambda name: (name is not None, name or ""))
    number = {name: i for i, name in enumerate(names)}
    ranks: list[np.ndarray] = []
    found: dict[bytes, tuple[int, dict[int, int]]] = {}
    at = 0
    for name, words in items:
        own = np.searchsorted(vocabulary, words) + 1
        ranks += [own, np.zeros(1, np.int64)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            found.setdefault(own[i : i + size].tobytes(), (size, {}))[1].setdefault(number[name], at + i)
        at += len(words) + 1
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(vocabulary & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    owners = [o for _, o in found.values()]
    flat = np.array([pair for o in owners for pair in o.items()], np.int64).reshape(-1, 2)
    first_owner = np.cumsum([0, *map(len, owners)])
    return BenchmarkBlock(vocabulary, np.concatenate([np.zeros(0, np.int64), *ranks]), flat[first_owner[:-1], 1], np.array([n for n, _ in found.values()], np.int64),
                          names, first_owner, flat[:, 0], flat[:, 1], maybe)


def word_ranks(hashes: np.ndarray, before: np.ndarray, block: BenchmarkBlock) -> np.ndarray:
    """Ranks of the words of all rows, one 0 after each row."""
    ranks = np.zeros(len(hashes), np.int64)
    some = np.flatnonzero(block.maybe[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    if len(some) and len(block.vocabulary):
        at = np.minimum(np.searchsorted(block.vocabulary, hashes[some]), len(block.vocabulary) - 1)
        ranks[some] = np.where(block.vocabulary[at] == hashes[some], at + 1, 0)
    rows = np.repeat(np.arange(len(before) - 1), np.diff(before))
    out = np.zeros(len(ranks) + len(before) - 1, np.int64)
    out[np.arange(len(ranks)) + rows] = ranks
    return out


def suffix_array(ranks: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` words, and these words packed as sort keys (suffix x key).

    A suffix with fewer than `depth` benchmark words in a row matches no window of that size, so it is left out.
    """
    stops = np.flatnonzero(ranks == 0)
    run = np.diff(stops, prepend=-1)
    starts = np.flatnonzero(np.repeat(stops, run) - np.arange(run.sum()) >= depth)
    keys = _packed(ranks, starts, depth, bits)
    order = np.lexsort(keys.T[::-1]) if len(starts) else np.zeros(0, np.int64)
    return starts[order], keys[order]


def _packed(ranks: np.ndarray, starts: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """The `depth` words from each start, several in a key column, the first in the highest bits."""
    per = 63 // bits
    keys = np.zeros((len(starts), -(-depth // per)), np.int64)
    for i in range(depth):
        keys[:, i // per] = (keys[:, i // per] << bits) | ranks[starts + i]
    return keys


def _bound(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all wanted key rows at once in sorted key rows."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        a, b = keys[middle], wanted[open_]
        differ = a != b
        first = differ.argmax(1)
        rows = np.arange(len(open_))
        up = np.where(differ.any(1), a[rows, first] < b[rows, first], right)
        low[open_[up]] = middle[up] + 1
        high[open_[~up]] = middle[~up]


def search(ranks: np.ndarray, block: BenchmarkBlock) -> tuple[np.ndarray, np.ndarray]:
    """(training position, window number) of all occurrences: each window's range of the suffix array, from two binary searches."""
    none = np.zeros(0, np.int64)
    if not len(block.suffixes):
        return none, none
    bits = len(block.vocabulary).bit_length()
    found = []
    for size in np.unique(block.lengths).tolist():
        suffixes, keys = suffix_array(ranks, size, bits)
        of = np.flatnonzero(block.lengths == size)
        wanted = _packed(block.ranks, block.suffixes[of], size, bits)
        low, high = _bound(keys, wanted, False), _bound(keys, wanted, True)
        n = high - low
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        found.append((suffixes[at], np.repeat(of, n)))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def longest(ranks: np.ndarray, positions: np.ndarray, places: np.ndarray, length: np.ndarray, block: BenchmarkBlock) -> np.ndarray:
    """Words that agree from each training position and benchmark place on, `length` at least, to the end of the common text."""
    length = length.copy()
    live = np.arange(len(positions))
    train, bench = np.append(ranks, 0), np.append(block.ranks, 0)
    while len(live):
        a, b = positions[live] + length[live], places[live] + length[live]
        live = live[(train[a] > 0) & (train[a] == bench[b])]
        length[live] += 1
    return length


HITS = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("longest", pa.int32())]))
HITS_SQL = "array<struct<at: int, words: int, item: string, longest: int>>"


def _finder(shared, text: str, drop: bool) -> Callable:
    """Adds the hits of one benchmark block to the column `hits`: word runs of every row, with an item each, and the longest match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches, text, SLICE_BYTES):
            hashes, before = word_hashes(*utf8(batch.column(text)))
            ranks = word_ranks(hashes, before, block)
            positions, windows = search(ranks, block)
            n = np.diff(block.first_owner)[windows]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block.first_owner[windows], n)
            positions, sizes = np.repeat(positions, n), np.repeat(block.lengths[windows], n)
            most = longest(ranks, positions, block.owner_at[at], sizes, block)
            begins = before[:-1] + np.arange(len(before) - 1)
            row = np.searchsorted(begins, positions, "right") - 1
            order = np.lexsort((block.owner[at], positions))
            per_row: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for r, a, w, item, m in zip(*(x[order].tolist() for x in (row, positions - begins[row], sizes, block.owner[at], most)), strict=True):
                per_row[r].append({"at": a, "words": w, "item": block.names[item], "longest": m})
            old = batch.column("hits").to_pylist()
            merged = [(o or []) + _runs(h) for o, h in zip(old, per_row, strict=True)]
            at = batch.schema.get_field_index("hits")
            words = batch.schema.get_field_index("n_words")
            columns = list(batch.columns)
            columns[at], columns[words] = pa.array(merged, HITS), pa.array(np.diff(before))
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield out.drop_columns([text]) if drop else out

    return run


def _runs(hits: list[dict]) -> list[dict]:
    """Overlapping and adjoining windows of one item become one run; no word is added that no window covers."""
    out: dict[str, list[dict]] = {}
    for h in hits:
        own = out.setdefault(h["item"], [])
        if own and h["at"] <= own[-1]["at"] + own[-1]["words"]:
            own[-1]["words"] = max(own[-1]["words"], h["at"] + h["words"] - own[-1]["at"])
            own[-1]["longest"] = max(own[-1]["longest"], h["longest"])
        else:
            own.append(h)
    return [h for own in out.values() for h in own]


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[BenchmarkBlock]:
    """The items, read in order of their ids, as blocks of a bounded number of words (one longer item is a block of its own)."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).orderBy("item", "text").toLocalIterator()
    held, size = [], 0
    for row in rows:
        words, _ = word_hashes(*utf8(pa.array([row["text"]], pa.string())))
        if held and size + len(words) > block_words:
            yield index_block(held, window)
            held, size = [], 0
        held.append((row["item"], words))
        size += len(words)
    yield index_block(held, window)


def benchmark_hits(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, block_words: int = BLOCK_WORDS, with_text: bool = True) -> DataFrame:
    """The columns of `df` (without the text, if that isn't wanted) with n_words and hits, which replace columns of these names.

    hits has, for every item with an occurring window, the covered word runs (at, words) and the most words that agree
    verbatim from a hit on (longest). An item with fewer words than a window is one window; an item without words
    has none. Items with a null id are one owner, `item` null. Null and empty texts have no words. Repeated items count once by id. No shuffle: each slice of
    documents is a shard with its own suffix array; benchmark blocks are bounded, so they are broadcast, one after another.
    """
    rest = df.drop("n_words", "hits")
    found = rest.withColumn("n_words", F.lit(None).cast("long")).withColumn("hits", F.lit(None).cast(HITS_SQL))
    blocks = benchmark_blocks(benchmark, item, item_text, window, block_words)
    block = next(blocks)
    while block:
        after = next(blocks, None)
        drop = after is None and not with_text
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if not (drop and f.name == text))
        found = found.mapInArrow(_finder(df.sparkSession.sparkContext.broadcast(block), text, drop), kinds)
        block = after
    return found


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `df` in which no benchmark window occurs."""
    return benchmark_hits(df, benchmark, text, window=window).where("size(hits) = 0").select(*[f"`{c}`" for c in df.columns])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for hits in batch.column("hits").to_pylist():
            covered, to = 0, 0
            for a, b in sorted((h["at"], h["at"] + h["words"]) for h in hits):
                covered += max(0, b - max(a, to))
                to = max(to, b)
            items = sorted({h["item"] for h in hits} - {None})  # a text without an id hits, but is no item
            n_hit.append(covered)
            n_items.append(len(items))
            digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = benchmark_hits(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
