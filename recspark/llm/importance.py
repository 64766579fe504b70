"""Importance resampling towards a target: hashed features of corpus and target give each document a weight, and the
highest weights plus Gumbel noise are a draw without replacement in proportion to the weights' exponentials.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import FOLD_ASCII, WORD_BYTES, ranged, slices, stored, table, utf8, word_spans
from recspark.llm.crc import crc32_spans

BUCKETS = 10000
# Bound of what is broadcast: gains of so many buckets, eight bytes each.
MOST_BUCKETS = 1 << 20
NGRAMS = (1, 1)
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
# Bytes of features hashed at one time.
CHUNK = 1 << 20


def feature_buckets(column: pa.Array, ngrams: tuple[int, int], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, number of features before each row, words of each row) of a text column."""
    data, offsets = utf8(column)
    data = FOLD_ASCII[data]
    starts, ends, before = word_spans(data, offsets, WORD_BYTES)
    if ngrams[1] > 1 and len(starts):
        # Words side by side with one blank between, so that a run of words is one span.
        sizes = ends - starts + 1
        to = np.cumsum(sizes)
        joined = np.full(int(to[-1]), 32, np.uint8)
        at = np.arange(int(to[-1]))
        inside = at + 1 != np.repeat(to, sizes)
        joined[inside] = data[(at + np.repeat(starts - (to - sizes), sizes))[inside]]
        data, starts, ends = joined, to - sizes, to - 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    froms, tos, owners = [], [], []
    for n in range(ngrams[0], ngrams[1] + 1):
        first = np.flatnonzero(rows[: max(len(rows) - n + 1, 0)] == rows[n - 1 :]) if n <= len(rows) else np.zeros(0, np.int64)
        froms.append(starts[first])
        tos.append(ends[first + n - 1])
        owners.append(rows[first])
    start, end, owner = np.concatenate(froms), np.concatenate(tos), np.concatenate(owners)
    if ngrams[0] < ngrams[1]:
        by_row = np.argsort(owner, kind="stable")
        start, end, owner = start[by_row], end[by_row], owner[by_row]
    cuts = np.searchsorted(np.cumsum(end - start), np.arange(0, int((end - start).sum()) + CHUNK, CHUNK)) if len(start) else np.zeros(0, np.int64)
    cuts = np.unique(np.append(cuts, [0, len(start)]))
    parts = [crc32_spans(data, start[a:b], end[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return (hashes % np.uint32(buckets)).astype(np.int64), np.searchsorted(owner, np.arange(len(offsets))), np.diff(before)


def _counter(ngrams: tuple[int, int], buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            total += np.bincount(feature_buckets(batch.column("text"), ngrams, buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", ngrams: tuple[int, int] = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any. Each task sends at most one row for a bucket.

    A text without a word, a null one and an empty table have no features; repeated rows count each time; other columns
    are not read.
    """
    each = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_counter(ngrams, buckets), "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed share of each bucket in the target over that in the corpus; at most `buckets` rows of each are read."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, into in ((corpus, s), (target, t)):
        for row in counts.collect():
            into[row.bucket] = row.n
    of_s, of_t = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * of_s / ((a + 1.0) * of_t))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigher(shared, ngrams: tuple[int, int], buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where, before, words = feature_buckets(batch.column("text"), ngrams, buckets)
            sums = np.append(0, np.cumsum(shared.value[where]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(words), pa.array(np.diff(before)), pa.array(np.diff(sums[before]))],
                                             names=["key", "n_words", "n_features", "weight"])

    return run


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", ngrams: tuple[int, int] = NGRAMS) -> DataFrame:
    """(key, n_words, n_features, weight) of every row: the gains of a text's features, summed; none for a text without words."""
    kind = docs.schema[key].dataType.simpleString()
    run = _weigher(docs.sparkSession.sparkContext.broadcast(gain), ngrams, len(gain))
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", ngrams: tuple[int, int] = NGRAMS,
             buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; `rank` counts the drawn ones from 1, best score first, and is null for the rest.

    A feature is a run of `ngrams` words; its bucket is its CRC-32 modulo `buckets`. The draw takes floor(percent * N / 100)
    of the N rows with `least_words` words or more; ties go to the smaller key, null keys last, and rows equal in key and
    score too are told apart by their features, then arbitrarily. The noise hangs on key and seed alone; a null key counts
    as empty text there. Null and empty texts have no features and weight 0; a single text may be of any length that one
    task holds. Repeated rows stay, each with a place of its own. Empty tables give no rows, an empty target the corpus'
    own shares. Other columns are not read, whatever their names. Texts are read twice and never shuffled; what is
    shuffled is a row of numbers for each document, and no task numbers more than a range of them.
    """
    gain = gains(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets), buckets)
    quoted = (seed + ":").replace("\\", "\\\\").replace("'", "\\'")
    noise = f"floor(-1000 * ln(-ln((bigint(conv(substring(sha2(concat('{quoted}', coalesce(string(key), '')), 256), 1, 8), 16, 10)) + 0.5D) / 4294967296D)))"
    scored = stored(weigh(docs, gain, key, text, ngrams).withColumn("score", F.expr(f"weight + {noise}")))
    order = (F.desc("score"), F.asc_nulls_last("key"), F.asc("n_features"), F.asc("weight"), F.asc("row"))
    many = ranged(scored.where(F.col("n_words") >= least_words).withColumn("row", F.monotonically_increasing_id()), *order)
    many = many.withColumn("range", F.expr("shiftright(pos, 33)"))
    sizes = many.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    before = sizes.selectExpr("range", "sum(n) over (order by range) - n as n_before", f"{int(percent)}L * sum(n) over () div 100 as n_drawn")
    place = "n_before + (pos & 8589934591L) + 1"
    ranked = many.join(before, "range").selectExpr("key", "n_features", "weight", "score", f"case when {place} <= n_drawn then {place} end as rank")
    few = scored.where(F.col("n_words") < least_words).selectExpr("key", "n_features", "weight", "score", "cast(null as bigint) as rank")
    return ranked.unionByName(few).withColumnRenamed("key", key)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
