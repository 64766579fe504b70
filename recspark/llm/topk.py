"""Exact top-k search by distributed histogram selection.

Every query's scores against all vectors are counted in histograms, first over the whole range, then inside the bin that holds
the k-th highest, until that bin is one value; then the scores from the k-th value on are kept and ties broken. Scores are made
anew in each round and never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from recspark.llm.common import stored, table

TOP = 5
QUERY_STEP = 50
BINS = 512
# Rows of one block of the queries and of the vectors: a task holds one of each.
QUERY_BLOCK = 2048
VECTOR_BLOCK = 32768
# Queries whose scores a task holds at one time.
ROWS = 64
# Products are made as floating-point numbers while these are exact, else as integers.
EXACT = float(1 << 53)


def quantized(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component as long; vectors null, empty or with null or non-finite components are left out.

    Rows that repeat key and vector count once. A component of 2^31 or more after scaling is an error, since scores are longs.
    """
    good = F.expr(f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, x -> coalesce(not isnan(x) and abs(x) < double('Infinity'), false))")
    return df.where(good & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.expr(f"transform(`{vector}`, x -> cast(floor(double(x) * {scale}) as int))").alias("v")).distinct()


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_list()).astype(np.int64)


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    q, v = np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)
    if float(q) * float(v) * queries.shape[1] < EXACT:
        return (queries.astype(np.float64) @ vectors.T.astype(np.float64)).astype(np.int64)
    if float(q) * float(v) * queries.shape[1] >= 2.0**63:
        raise ArithmeticError("scores exceed the range of long")
    return queries @ vectors.T


def _each(queries: pd.DataFrame, vectors: pd.DataFrame) -> Iterator[np.ndarray]:
    """Scores of one query after the other."""
    q, v = _matrix(queries), _matrix(vectors)
    for at in range(0, len(q), ROWS):
        yield from _scores(q[at : at + ROWS], v)


def _blocks(scoring: Callable) -> Callable:
    """Runs `scoring(query rows, vector rows)` for a pair of blocks."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return scoring(queries.iloc[:0], vectors.iloc[:0])
        return scoring(queries, vectors)

    return run


def _histogram(bins: int) -> Callable:
    """Counts of the scores in the bins of each query's range: (id, bin, n)."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        ids, found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(queries):
            own = vectors["id"].to_numpy()
            for scores, (key, low, high) in zip(_each(queries, vectors), queries[["id", "low", "high"]].itertuples(index=False), strict=True):
                inside = scores[(scores >= low) & (scores < high) & (own != key)]
                width = -((low - high) // bins)
                n = np.bincount((inside - low) // width, minlength=1)
                at = np.flatnonzero(n)
                ids.append(np.full(len(at), key))
                found.append(at)
                counts.append(n[at])
        return pd.DataFrame({"id": np.concatenate(ids), "bin": np.concatenate(found), "n": np.concatenate(counts)})

    return run


def _select(top: int) -> Callable:
    """Scores from the k-th value on; of those equal to it a block's `top` smallest ids suffice."""

    def run(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        ids, keys, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(queries):
            own = vectors["id"].to_numpy()
            for scores, (key, low) in zip(_each(queries, vectors), queries[["id", "low"]].itertuples(index=False), strict=True):
                at = np.flatnonzero((scores >= low) & (own != key))
                at = at[np.lexsort((own[at], -scores[at]))][:top]
                ids.append(np.full(len(at), key))
                keys.append(own[at])
                found.append(scores[at])
        return pd.DataFrame({"query_id": np.concatenate(ids), "vec_id": np.concatenate(keys), "score": np.concatenate(found)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` highest integer inner products of each query, ties to the smaller vec_id.

    Both tables are (id, v) as `quantized` gives them; a query's own id is no candidate; fewer candidates give fewer rows.
    Vectors of another length than the query's are no candidates. Each pair of blocks meets in one task: queries are copied
    to every block of vectors and vectors to every block of queries, which is the work of exact search; a round sends on
    only counts, at most `bins` a query and block.
    """
    vectors = vectors.withColumn("size", F.size("v"))
    queries = queries.withColumn("size", F.size("v"))
    n_queries, n_vectors = queries.count(), vectors.count()
    q_blocks, v_blocks = max(1, ceil(n_queries / query_block)), max(1, ceil(n_vectors / vector_block))
    side = stored(vectors.select("id", "v", "size", F.pmod(F.xxhash64("id", "v"), F.lit(v_blocks)).cast("int").alias("vb"),
                                 F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb")))
    # |score| <= |q| * |v|: the first histogram spans that.
    longest = vectors.groupBy("size").agg(F.max(F.expr("aggregate(v, 0d, (s, x) -> s + double(x) * x)")).alias("most"))
    ranged = queries.join(F.broadcast(longest), "size").withColumn("bound", F.expr("bigint(floor(sqrt(most * aggregate(v, 0d, (s, x) -> s + double(x) * x)) * 1.000001)) + 1"))
    # A query's range of scores [low, high) that holds its k-th highest, and how many of its `top` are still to be found in it.
    state = stored(ranged.select("id", "v", "size", (-F.col("bound")).alias("low"), (F.col("bound") + 1).alias("high"), F.lit(top).cast("long").alias("left"), F.lit(True).alias("open")))

    def met(current: DataFrame, work: Callable, schema: str) -> DataFrame:
        asked = current.withColumn("qb", F.pmod(F.xxhash64("id", "v"), F.lit(q_blocks)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
        return asked.groupBy("qb", "vb", "size").cogroup(side.groupBy("qb", "vb", "size")).applyInPandas(_blocks(work), schema)

    while state.where("open").limit(1).count():
        counted = met(state.where("open"), _histogram(bins), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("id").orderBy(F.desc("bin"))  # at most `bins` rows a query
        above = counted.withColumn("above", F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        kth = above.join(state.select("id", "left"), "id").where("above < left and left <= above + n").select("id", "bin", "above")
        width = f"bigint(ceil((high - low) / {bins}D))"
        # Without a k-th score all that remain belong to the result.
        state = stored(state.join(kth, "id", "left").withColumn("width", F.expr(width)).select(
            "id", "v", "size", F.expr("if(bin is null, low, low + bin * width)").alias("low"), F.expr("if(bin is null, high, least(high, low + (bin + 1) * width))").alias("high"),
            F.expr("left - coalesce(above, 0)").alias("left"), F.expr("open and bin is not null and width > 1").alias("open")))
    found = met(state, _select(top), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most `top` rows a query and block
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(quantized(table(spark, sf_dir, "embeddings")))
    return top_k(vectors, vectors.where(f"id % {QUERY_STEP} = 0"))
