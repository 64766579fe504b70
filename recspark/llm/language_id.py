"""Language ID: multinomial naive Bayes over hashed character n-grams, scored in sparse numpy batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import slices, table

BUCKET_BITS = 16
ORDERS = (2, 3)
SMOOTHING = 0.1
# Bound of the fit: about so many labelled rows of a language, drawn by a hash of the id.
FIT_ROWS_PER_LANGUAGE = 4000
# Bound of the broadcast: languages x buckets x 4 bytes.
MODEL_BYTES = 256 << 20
BLOCK = 1 << 19
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of rows
    weights: np.ndarray  # languages x buckets, log probability


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else a blank."""
    fold = np.full(sys.maxunicode + 1, 32, np.uint32)
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            fold[code] = ord(low) if len(low) == 1 else code
    return fold


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts in one array, with room for blanks before each text: (codes, starts, ends)."""
    pad = max(ORDERS) - 1
    whole = [t or "" for t in texts.to_pylist()]
    lengths = np.fromiter(map(len, whole), np.int64, len(whole))
    joined = "".join(" " * pad + t for t in whole)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths + pad)
    return _letters()[codes], ends - lengths, ends


def gram_buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that ends at each position from `order` - 1 on."""
    n = len(codes) - order + 1
    h = np.full(n, order * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h ^= codes[i : i + n]
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - BUCKET_BITS)


def _blocks(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, rows, first index of each row) of bounded stretches; an n-gram counts where it ends, inside its text.

    N-grams of blanks only say nothing and go to no bucket.
    """
    pad = max(ORDERS) - 1
    for at in range(pad, len(codes), BLOCK):
        to = min(at + BLOCK, len(codes))
        row = np.searchsorted(ends, np.arange(at, to), "right")
        for order in ORDERS:
            part = codes[at - order + 1 : to]
            letters = part != 32
            some = letters[order - 1 :].copy()
            for i in range(order - 1):
                some |= letters[i : i + to - at]
            some &= np.arange(at, to) >= starts[row]
            rows = row[some]
            if len(rows):
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                yield gram_buckets(part, order)[some], rows[first], first


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: (lang, bucket, n)."""
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        langs = batch.column("lang").to_pylist()
        codes, starts, ends = folded(batch.column("text"))
        for buckets, rows, first in _blocks(codes, starts, ends):
            for row, part in zip(rows, np.split(buckets, first[1:]), strict=True):
                totals.setdefault(langs[row], np.zeros(1 << BUCKET_BITS, np.int64))[:] += np.bincount(part, minlength=1 << BUCKET_BITS)
    for lang, counts in totals.items():
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["lang", "bucket", "n"])


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = FIT_ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learn from about `rows_per_language` rows of each language, drawn by a hash of key and text; all rows where there are fewer.

    Rows with null text or language teach nothing. Without any labelled row the model has no language and predicts `und`.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    if len(languages) * (4 << BUCKET_BITS) > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages exceed the bound of the model, {MODEL_BYTES} bytes")
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, 1 << BUCKET_BITS), np.float32))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, rows_per_language / totals[k]))])
    sample = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    counted = sample.select("text", "lang").mapInArrow(_counter, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # languages x buckets rows at most
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    at = np.searchsorted(np.array(languages, object), np.array(found.column("lang").to_pylist(), object)) if found.num_rows else np.zeros(0, int)
    counts[at, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    weights = np.log((counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1]))
    rows_of = np.array([totals[k] for k in languages], float)
    return LanguageModel(languages, np.log(rows_of / rows_of.sum()), weights.astype(np.float32))


def score_texts(texts: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Most probable language of each text and its posterior; no letter or no text: `und` with score 0."""
    codes, starts, ends = folded(texts)
    sums = np.zeros((len(texts), len(model.languages)))
    grams = np.zeros(len(texts), np.int64)
    for buckets, rows, first in _blocks(codes, starts, ends):
        grams[rows] += np.diff(np.r_[first, len(buckets)])
        for i, weights in enumerate(model.weights):
            sums[rows, i] += np.add.reduceat(weights[buckets], first, dtype=np.float64)
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    sums += model.prior
    best = sums.argmax(1)
    top = sums.max(1, keepdims=True)
    score = np.where(grams > 0, 1 / np.exp(sums - top).sum(1), 0.0)
    return [model.languages[b] if g else UNDETERMINED for b, g in zip(best, grams, strict=True)], score


def _scorer(shared, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            languages, score = score_texts(batch.column(text), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(languages, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The columns of `df` with lang_pred and score, which replace columns of those names.

    Null texts and texts without a letter get `und` and score 0. Whole texts count, in bounded stretches; repeated rows stay;
    equal posteriors go to the language that sorts first. The model is bounded by MODEL_BYTES, so it is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = df.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(_scorer(shared, text), f"{kinds}, lang_pred string, score double")


def held_out(key: str, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    scored = identify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
