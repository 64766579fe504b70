"""Exact nearest neighbours by cosine, as a blocked matrix product.

Queries form hash slices, catalogue vectors form hash parts, both of bounded size, and each
(part, slice) cell is one cogroup. Inside a cell the products run tile by tile in single
precision, and only what can still reach a query's top k by more than their rounding error is
scored exactly, in double precision, so a cell gives exactly k rows a query, ties by id. Neither
a row-level product of the two sides nor a whole side ever exists in one task. Total work is
queries x items; rows emitted are queries x parts x k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.ordered import top_k
from recspark.session import materialize

# Most items and queries of a cell: they bound the memory and the work of one task.
BLOCK_ROWS = 131_072
SLICE_ROWS = 16_384
# Fewest queries of a slice, while there are fewer cells than CELLS_PER_CORE a core.
LEAST_ROWS = 256
CELLS_PER_CORE = 4
# Queries and items of one product, and pairs that are scored exactly at once.
TILE_QUERIES = 1024
TILE_ITEMS = 4096
PAIRS = 1 << 17


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """The unit vectors of a column of equally long lists; null components become NaN."""
    lists = column.combine_chunks()
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    with np.errstate(invalid="ignore", over="ignore"):
        return _unit(flat.reshape(len(lists), -1))


def _lowest_of_copies(m: np.ndarray, most: int) -> np.ndarray:
    """Positions of at most the first `most` rows of each vector: more equal ones can't reach a top `most`."""
    if len(m) <= most or not m.shape[1]:
        return np.arange(len(m))
    rows = np.ascontiguousarray(m + 0.0).view(f"V{m.shape[1] * m.itemsize}").ravel().astype(object)
    number = pd.Series(pd.factorize(rows)[0])
    return np.flatnonzero(number.groupby(number).cumcount().to_numpy() < most)


def _exact(q: np.ndarray, m: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Scores of pairs at twelve decimals: equal cosines tie, however their sums round and wherever the vectors stand."""
    parts = [(q[row[at:at + PAIRS]] * m[col[at:at + PAIRS]]).sum(axis=1) for at in range(0, len(row), PAIRS)]
    return np.round(np.concatenate(parts), 12) + 0.0 if parts else np.zeros(0)


def best_pairs(q: np.ndarray, m: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the `wanted` best columns of each row of the product of unit vectors, ties to the first column.

    A pair is passed over only if its rough score is below that of the last of `wanted` pairs by more than both can be off.
    """
    slack = np.float32(4 * (q.shape[1] + 4) * np.finfo(np.float32).eps)
    q32, m32 = q.astype(np.float32), np.ascontiguousarray(m.astype(np.float32).T)
    order = np.argsort(wanted, kind="stable")
    out = []
    for start in range(0, len(q), TILE_QUERIES):
        own = order[start:start + TILE_QUERIES]
        want, places, most = wanted[own], np.arange(len(own)), int(wanted[own].max())
        bar = np.full(len(own), -np.inf, dtype=np.float32)
        kept, found, n_found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)), [], 0
        for at in range(0, len(m), TILE_ITEMS):
            rough = q32[own] @ m32[:, at:at + TILE_ITEMS]
            width = rough.shape[1]
            if at == 0 and most < width:
                bar = np.partition(rough, width - most, axis=1)[:, width - most] - slack
            hit = np.flatnonzero(rough >= bar[:, None])
            found.append((hit // width, hit % width + at))
            n_found += len(hit)
            if n_found < min(int(want.sum()), PAIRS) and at + TILE_ITEMS < len(m):
                continue
            row, col = (np.concatenate(x) for x in zip(*found, strict=True))
            found, n_found = [], 0
            row, col, score = (np.concatenate(x) for x in zip(kept, (row, col, _exact(q, m, own[row], col)), strict=True))
            by = np.lexsort((col, -score, row))
            row, col, score = row[by], col[by], score[by]
            keep = np.arange(len(row)) - np.searchsorted(row, places)[row] < want[row]
            kept = row, col, score = row[keep], col[keep], score[keep]
            n = np.bincount(row, minlength=len(own))
            full = np.flatnonzero(n == want)
            bar[full] = score[np.cumsum(n)[full] - 1].astype(np.float32) - slack
        out.append((own[kept[0]], *kept[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_of_cell(k: int):
    def run(asked: pa.Table, items: pa.Table) -> pa.Table:
        extra = asked["extra"].to_numpy().astype(np.int64)
        ids = np.asarray(items["content_id"].to_numpy(zero_copy_only=False), dtype=object)
        by_id = np.argsort(ids, kind="stable")
        if not len(extra) or not len(ids):
            return _CELL.empty_table()
        m = _rows(items["vec"])[by_id]
        known = np.flatnonzero(np.isfinite(m).all(axis=1))
        known = known[_lowest_of_copies(m[known], int(k + extra.max()))]
        row, col, score = best_pairs(_rows(asked["qvec"]), m[known], np.minimum(k + extra, len(known)))
        return pa.Table.from_arrays([
            asked["qid"].combine_chunks().take(pa.array(row)), items["content_id"].combine_chunks().take(pa.array(by_id[known[col]])),
            pa.array(score), pa.array((k + extra)[row].astype(np.int32)),
        ], schema=_CELL)

    return run


_CELL = pa.schema([("qid", pa.string()), ("content_id", pa.string()), ("score", pa.float64()), ("wanted", pa.int32())])


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, content_id, score, rank): the k best items of each query (ties by id).

    ``queries`` has qid and qvec; ``vectors`` has content_id and vec of the same length.
    An optional int column ``extra`` asks for k + extra items, so that a caller that drops
    up to ``extra`` known items afterwards still has k.
    """
    spark = queries.sparkSession
    have = vectors.filter("vec IS NOT NULL")
    parts = max(1, -(-have.count() // BLOCK_ROWS))
    asked = materialize(queries.filter("qvec IS NOT NULL").selectExpr(
        "CAST(qid AS STRING) AS qid", "qvec", "CAST(extra AS INT) AS extra" if "extra" in queries.columns else "0 AS extra"))
    n = asked.count()
    cells = CELLS_PER_CORE * spark.sparkContext.defaultParallelism
    slices = max(1, -(-n // SLICE_ROWS), min(-(-cells // parts), -(-n // LEAST_ROWS)))
    items = have.selectExpr("content_id", "vec", f"pmod(xxhash64(content_id), {parts}L) AS part", f"explode(sequence(0L, {slices - 1}L)) AS slice")
    spread = asked.selectExpr("qid", "qvec", "extra", f"pmod(xxhash64(qid), {slices}L) AS slice", f"explode(sequence(0L, {parts - 1}L)) AS part")
    best = spread.groupBy("part", "slice").cogroup(items.groupBy("part", "slice")).applyInArrow(_best_of_cell(k), "qid string, content_id string, score double, wanted int")
    order = [F.col("score").desc(), F.col("content_id")]
    if "extra" not in queries.columns:
        return top_k(best, ["qid"], order, k, rank="rank").drop("wanted")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked.filter("rank <= wanted").drop("wanted")
