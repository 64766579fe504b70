"""Toxicity: a factorization machine over hashed terms; pairs of terms count beside the single ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.llm.common import FOLD_ASCII, WORD_BYTES, mixed, prefix_hash, slices, span_hash, table, utf8, word_spans
from recspark.llm.language_id import held_out

BUCKET_BITS = 24
# First bytes of words that are terms beside the whole words.
STEMS = (4, 5, 6)
FACTORS = 8
# Bounds of the fit: about so many labelled rows of each class, drawn by a hash of the id, and terms of one text at most.
FIT_ROWS_PER_CLASS = 4000
FIT_TERMS = 4096
# A term needs this share of the fitted rows, three rows, and this much association with the label (chi-square, one degree).
MIN_SHARE = 0.002
SCREEN = 18.0
EPOCHS = 20
BATCH_ROWS = 256
STEP = 0.05
DECAY = 1e-3


@dataclass(frozen=True)
class FactorizationMachine:
    """Weights of the terms that the fit met often enough; all others have none."""

    buckets: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # terms x FACTORS


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the different hashed terms of each row, sorted: lower-cased words and their first bytes."""
    folded = FOLD_ASCII[data]
    starts, ends, before = word_spans(folded, offsets, WORD_BYTES)
    prefix = prefix_hash(folded)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    keys = []
    for n, stem in enumerate((None, *STEMS)):
        some = np.arange(len(starts)) if stem is None else np.flatnonzero(ends - starts >= stem)
        stop = ends[some] if stem is None else starts[some] + stem
        h = mixed(span_hash(prefix, starts[some], stop) + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)
        keys.append((rows[some] << BUCKET_BITS) + h.astype(np.int64))
    found = np.unique(np.concatenate(keys))
    return found >> BUCKET_BITS, found & ((1 << BUCKET_BITS) - 1)


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the values of each row; rows are sorted."""
    out = np.zeros((n, *values.shape[1:]))
    if len(rows):
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _margins(model: FactorizationMachine, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each row and the sums of its factors: bias + single weights + products of all pairs of its terms."""
    v = model.factors[at]
    sums = _sums(v, rows, n)
    pairs = 0.5 * ((sums**2).sum(1) - _sums((v**2).sum(1), rows, n))
    return model.bias + _sums(model.weights[at], rows, n) + pairs, sums


def _known(model: FactorizationMachine, rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the terms that the model has."""
    if not len(model.buckets):
        return rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(model.buckets, buckets), len(model.buckets) - 1)
    real = model.buckets[at] == buckets
    return rows[real], at[real]


def score_texts(texts: pa.Array, model: FactorizationMachine) -> np.ndarray:
    """Probability of label 1 of each text; null and empty texts get that of a text without known terms."""
    rows, buckets = terms(*utf8(texts))
    margin, _ = _margins(model, *_known(model, rows, buckets), len(texts))
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, buckets = terms(*utf8(batch.column("text")))
        per_row = np.split(buckets, np.searchsorted(rows, np.arange(1, batch.num_rows)))
        drawn = [x if len(x) <= FIT_TERMS else np.sort(x[np.argsort(mixed(x.astype(np.uint64)))[:FIT_TERMS]]) for x in per_row]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x.astype(np.int32) for x in drawn], pa.list_(pa.int32()))], names=["id", "label", "buckets"])


def train(labels: np.ndarray, per_row: list[np.ndarray], epochs: int = EPOCHS, seed: int = 7) -> FactorizationMachine:
    """Weighted logistic loss (both classes count alike), AdaGrad steps over batches of rows, in a fixed order."""
    flat = np.concatenate([np.zeros(0, np.int64), *per_row]).astype(np.int64)
    buckets, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    with_one = np.bincount(which, np.repeat(labels, [len(x) for x in per_row]), len(buckets)) if len(flat) else np.zeros(0)
    n, ones = len(labels), float(labels.sum())
    expected = counts * ones / max(n, 1)
    spread = expected * (1 - ones / max(n, 1)) * (1 - counts / max(n, 1))
    chi = np.divide((with_one - expected) ** 2, spread, out=np.zeros(len(buckets)), where=spread > 0)
    buckets = buckets[(counts >= max(3, MIN_SHARE * n)) & (chi >= SCREEN)]
    rng = np.random.RandomState(seed)
    model = FactorizationMachine(buckets, 0.0, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS)))
    if not len(labels) or not len(buckets):
        # Nothing to tell texts apart by: the share of label 1 decides, and without labels none is predicted.
        return FactorizationMachine(buckets, float(np.log((ones + 0.5) / (n - ones + 1))), model.weights, model.factors)
    places = []
    for own in per_row:
        _, at = _known(model, np.zeros(len(own), np.int64), own.astype(np.int64))
        places.append(at)
    share = max(labels.mean(), 1 / len(labels))
    cost = np.where(labels == 1, 0.5 / share, 0.5 / max(1 - share, 1 / len(labels)))
    bias, w, v = 0.0, model.weights, model.factors
    gb, gw, gv = 1e-8, np.full(w.shape, 1e-8), np.full(v.shape, 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH_ROWS):
            some = order[i : i + BATCH_ROWS]
            sizes = np.array([len(places[r]) for r in some])
            rows, at = np.repeat(np.arange(len(some)), sizes), np.concatenate([np.zeros(0, np.int64), *(places[r] for r in some)])
            margin, sums = _margins(FactorizationMachine(buckets, bias, w, v), rows, at, len(some))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) * cost[some] / len(some)
            used, where = np.unique(at, return_inverse=True)
            each = slope[rows]
            dw = np.bincount(where, each, len(used)) + DECAY * w[used]
            dv_rows = each[:, None] * (sums[rows] - v[at])
            dv = np.stack([np.bincount(where, dv_rows[:, f], len(used)) for f in range(v.shape[1])], 1) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= STEP * dw / np.sqrt(gw[used])
            v[used] -= 0.2 * STEP * dv / np.sqrt(gv[used])
            gb += slope.sum() ** 2
            bias -= STEP * slope.sum() / np.sqrt(gb)
    return FactorizationMachine(buckets, float(bias), w.astype(np.float32), v.astype(np.float32))


def fit(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> FactorizationMachine:
    """Learn from all rows given, which `labelled_sample` bounds.

    Labels other than 0 and 1 and null texts teach nothing, repeated rows once. The rows are hashed in tasks, and at most
    FIT_TERMS terms of each come to the driver. Without rows, or without a telling term,
    every score is that of the share of label 1 (smoothed; a third without any rows).
    """
    named = rows.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    drawn = named.mapInArrow(_term_rows, "id string, label int, buckets array<int>").distinct()
    found = drawn.toArrow()
    # Tasks end in any order; the fit must not depend on it.
    order = sorted(range(found.num_rows), key=lambda i, ids=found.column("id").to_pylist(), b=found.column("buckets").to_pylist(): (ids[i] or "", b[i]))
    lists = found.column("buckets").combine_chunks()
    flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() if found.num_rows else np.zeros(1, int)
    at = at - at[0]
    return train(found.column("label").to_numpy()[order].astype(float), [flat[at[i] : at[i + 1]] for i in order])


def _scorer(shared, text: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text):
            score = score_texts(batch.column(text), model)
            kept = batch.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*kept.schema.names, "score", "predicted"])

    return run


def toxicity(df: DataFrame, model: FactorizationMachine, text: str = "text") -> DataFrame:
    """The columns of `df` but the text, with score and predicted, which replace columns of these names.

    Every row gets a score, null and empty texts too; repeated rows stay and score alike; an empty table gives no rows.
    The model has at most FIT_TERMS / MIN_SHARE terms (far fewer pass the screening) and is broadcast. No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = df.drop("score", "predicted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema if f.name != text)
    return rest.mapInArrow(_scorer(shared, text), f"{kinds + ', ' if kinds else ''}score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows_per_class: int = FIT_ROWS_PER_CLASS) -> DataFrame:
    """Rows of `docs` with a label, about `rows_per_class` of each class, drawn from the distinct labels by a hash of the key.

    The drawn labels are bounded by that parameter, so they are broadcast and `docs` isn't shuffled.
    """
    own = labels.select(F.col(key), F.col(label).cast("int").alias("label")).where("label in (0, 1)").distinct()
    totals = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bound = F.expr("case label " + " ".join(f"when {k} then {min(1.0, rows_per_class / n)}D" for k, n in totals.items()) + " else 0D end" if totals else "0D")
    drawn = own.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < bound * 1_000_003)
    return docs.join(F.broadcast(drawn), key)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    model = fit(labelled_sample(docs, labels))
    return toxicity(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
