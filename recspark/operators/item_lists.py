"""Work on many short lists of items that needs the items' vectors, such as scoring or ordering candidates.

A vector takes a hundred times the room of an id, and the same items are in many lists. So the lists travel as ids: they are
dealt over blocks, each block gets the vectors of its different items once, and one cogroup a block brings both together.
A block is bounded by its lists, its ids and its different items, which bound the memory of a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.vectors import unit_rows

# Most lists, ids, and different items of a block.
BLOCK_LISTS = 16_384
BLOCK_IDS = 1 << 20
BLOCK_ITEMS = 131_072
# Fewest ids of a block, while there are fewer blocks than BLOCKS_PER_CORE a core.
LEAST_IDS = 16_384
BLOCKS_PER_CORE = 4


def block_count(n_lists: int, n_ids: int, n_items: int, cores: int) -> int:
    """How many blocks the lists are dealt over. Where all items fit one block, any list may go to any block."""
    ids = BLOCK_IDS if n_items <= BLOCK_ITEMS else BLOCK_ITEMS
    return max(1, -(-n_lists // BLOCK_LISTS), -(-n_ids // ids), min(BLOCKS_PER_CORE * cores, -(-n_ids // LEAST_IDS)))


def dealt(lists: DataFrame, keys: list[str], ids: list[str], catalogue) -> tuple[DataFrame, DataFrame]:
    """The lists with their block, and (block, content_id, flat, known): the vectors that a block's lists name, each once.

    lists: keys, and arrays of content ids in the columns ``ids``; it is read several times, so it should be stored.
    """
    size = " + ".join(f"coalesce(size({c}), 0)" for c in ids)
    n_lists, n_ids = lists.agg(F.count("*"), F.expr(f"coalesce(sum({size}), 0)")).first()
    blocks = block_count(n_lists, n_ids, catalogue.n_vectors, lists.sparkSession.sparkContext.defaultParallelism)
    block = f"pmod(xxhash64({', '.join(keys)}), {blocks}L) AS block"
    none = "CAST(array() AS ARRAY<STRING>)"
    every = ", ".join(f"coalesce({c}, {none})" for c in ids)
    named = lists.selectExpr(block, f"explode(concat({every})) AS content_id").distinct()
    return lists.selectExpr("*", block), named.join(catalogue.vectors_by_id, "content_id").select("block", "content_id", "flat", "known")


def typed(df: DataFrame, columns: list[str], others: str) -> str:
    """Schema text of some columns of a table and others beside them."""
    return ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns), others])


def list_sizes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_values(column: pa.ChunkedArray) -> np.ndarray:
    """The numbers of all lists one after another; nulls become NaN."""
    return np.asarray(pc.list_flatten(column).to_numpy(zero_copy_only=False), dtype=np.float64)


def bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class Vectors:
    """The vectors of a block: unit rows in ``rows``, whether each is known, and where the ids of a list column stand.

    An id without a vector has one row of zeros that is not known. An id may have several vectors, which all count.
    """

    def __init__(self, items: pa.Table):
        self.ids = items["content_id"].combine_chunks()
        self.copies = np.concatenate([list_sizes(items["known"]), [1]])
        self.start = bounds(self.copies)[:-1]
        n = int(self.copies[:-1].sum())
        flat = flat_values(items["flat"])
        rows = flat.reshape(n, len(flat) // max(n, 1))
        self.rows = unit_rows(np.concatenate([rows, np.zeros((1, rows.shape[1]))]))
        known = pc.list_flatten(items["known"]).to_numpy(zero_copy_only=False)
        self.known = np.concatenate([np.asarray(known, dtype=bool), [False]])

    def of(self, column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list bounds, place, row) of a column of id lists: row of ``rows``, and place of its id among all ids."""
        ids = pc.list_flatten(column)
        found = pc.fill_null(pc.index_in(ids, value_set=self.ids), len(self.ids)).to_numpy(zero_copy_only=False).astype(np.int64)
        copies = self.copies[found]
        place = np.repeat(np.arange(len(found)), copies)
        nth = np.arange(len(place)) - np.repeat(bounds(copies)[:-1], copies)
        return bounds(copies)[bounds(list_sizes(column))], place, self.start[found][place] + nth
