"""SimHash near-duplicates: fingerprints, a grid join over segment popcounts, exact verification, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import FOLD_ASCII, NONSPACE_BYTES, SLICE_BYTES, slices, stored, table, utf8, word_spans
from recspark.llm.components import components
from recspark.llm.xxh64 import xxh64

SHINGLE = 3
RADIUS = 2
# Segments of two bits: a popcount of 0, 1 or 2 each.
SEGMENTS = 32
# Axis blocks of the grid; vectors at Manhattan distance r agree on all but r of them.
AXIS_BLOCKS = 5
# Cells with more fingerprints than this are linked over shared neighbours instead of pair by pair.
CELL_LIMIT = 64
SHINGLES_AT_ONCE = 1 << 18


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words, one blank after each, in one buffer: (bytes, word starts, word ends, words before each row)."""
    folded = FOLD_ASCII[data]
    starts, ends, before = word_spans(folded, offsets, NONSPACE_BYTES)
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[to + sizes] = False
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    out[keep] = folded[np.cumsum(inside[:-1]) > 0]
    return out, to, to + sizes, before


def fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of every row: a bit is set if it is set in over half of the row's shingle hashes, repeats included."""
    text, starts, ends, before = _spaced(data, offsets)
    words = np.diff(before)
    counts = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    row_of = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    votes = np.zeros((len(counts), 64), np.int64)
    for at in range(0, len(row_of), SHINGLES_AT_ONCE):
        rows = row_of[at : at + SHINGLES_AT_ONCE]
        begin = before[rows] + np.arange(at, at + len(rows)) - first[rows]
        last = np.minimum(begin + shingle, before[rows + 1]) - 1
        bits = np.unpackbits(xxh64(text, starts[begin], ends[last]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        votes[rows[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
    most = votes * 2 > counts[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def _fingerprinter(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            found = fingerprints(*utf8(batch.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found.view(np.int64))], names=["key", "fp"])

    return run


def simhash(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): 64-bit fingerprint of every row; a text without words, empty or null has 0, one with fewer words than a
    shingle is one shingle. No shuffle."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(_fingerprinter(shingle), f"key {kind}, fp long").withColumnRenamed("key", key)


def _two_bit_popcounts(fp: str) -> str:
    """SQL: all 32 popcounts of two-bit segments packed into the bit pairs of one long, by bit operations only (no overflow)."""
    next_bit = f"shiftrightunsigned({fp}, 1)"
    return f"((({fp} ^ {next_bit}) & 6148914691236517205L) | shiftleft({fp} & {next_bit} & 6148914691236517205L, 1))"


def _manhattan(a: str, b: str) -> str:
    """SQL: Manhattan distance of two packed embeddings. Where two counts differ by 1 the xor is 01 or 11 (1 against 2), by 2 it is 10."""
    x = f"({a} ^ {b})"
    low, high = f"({x} & 6148914691236517205L)", f"(shiftrightunsigned({x}, 1) & 6148914691236517205L)"
    return f"(bit_count({low}) + 2 * bit_count({high} & ~{low}))"


def _cells(radius: int, axis_blocks: int) -> Column:
    """Keys of the grids a vector lies in: one grid for each choice of axis blocks on which neighbours must agree.

    Neighbours differ by at most `radius` in the sum over all axes, so at most `radius` axis blocks differ and the cells
    of at least one projection coincide; no cell beside it needs a look.
    """
    edges = [round(i * SEGMENTS / axis_blocks) for i in range(axis_blocks + 1)]
    masks = [((1 << 2 * edges[i + 1]) - 1) ^ ((1 << 2 * edges[i]) - 1) for i in range(axis_blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(axis_blocks), axis_blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        keys.append(f"struct({n} as grid, pop & {mask - (1 << 64) if mask >> 63 else mask}L as cell)")
    return F.expr(f"array({', '.join(keys)})")


def links(distinct: DataFrame, radius: int = RADIUS, axis_blocks: int | None = None, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b): edges between different fingerprints that connect exactly what links at `radius` or fewer bits connect.

    `distinct` has one row per fingerprint in column fp. Cells up to `cell_limit` members compare their pairs, Manhattan
    distance first. Fuller cells go another exact way (radius 2 at most): two fingerprints at 2 or fewer bits share a
    fingerprint at 1 or fewer bits of both, so each emits itself and its 64 neighbours, and all that emit the same one hang
    on the smallest of them; those at distance 1 of a common neighbour are at 2 or fewer bits of each other.
    """
    if not 0 <= radius <= 2:
        raise ValueError("fuller cells are linked exactly up to radius 2")
    axis_blocks = axis_blocks or radius + 3
    placed = distinct.select("fp", F.expr(_two_bit_popcounts("fp")).alias("pop")).withColumn("at", F.explode(_cells(radius, axis_blocks))).select("fp", "pop", "at.grid", "at.cell")
    placed = stored(placed)
    size = placed.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    met = placed.join(size, ["grid", "cell"])
    few = met.where(F.col("n") <= cell_limit)
    pairs = few.alias("x").join(few.alias("y"), ["grid", "cell"]).where("x.fp < y.fp").where(
        f"{_manhattan('x.pop', 'y.pop')} <= {radius}").where(f"bit_count(x.fp ^ y.fp) <= {radius}").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = met.where(F.col("n") > cell_limit).select("fp").distinct()
    around = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("near"))
    least = around.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = around.join(least, "near").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(shared).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key reachable over fingerprints at `radius` or fewer bits.

    Rows with equal fingerprints are linked, those without words too; repeated rows stay. A null key keeps its row and
    never is the smallest unless its whole component has null keys. Other columns are not read. Fingerprints are joined
    once each, so a group of copies costs one row; only the smallest key of each fingerprint goes on.
    """
    marked = stored(simhash(df, key, text, shingle))
    owners = stored(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = stored(components(links(owners.select("fp"), radius)))
    joined = owners.join(roots, owners.fp == roots.node).select("fp", "least", "root")
    found = joined.groupBy("root").agg(F.min("least").alias("smallest"))
    moved = joined.join(found, "root").select("fp", F.col("smallest").alias("component_id"))
    # Stored, so that adaptive execution can split the fingerprint of many copies in the last join.
    least = stored(owners.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return marked.join(least, "fp").select(key, "fp", "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
