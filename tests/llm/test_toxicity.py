import math
import random
import re

import numpy as np
import pyarrow as pa

from recspark.llm import toxicity as tx
from recspark.llm.common import utf8


def test_margin_is_the_sum_over_all_pairs():
    texts = ["Bad people", "été bad people, bad", "", None, "unknown words"]
    rows, buckets = tx.terms(*utf8(pa.array(texts)))
    rng = np.random.RandomState(0)
    known = np.unique(buckets[rows < 2])
    model = tx.FactorizationMachine(known, 0.3, rng.normal(size=len(known)), rng.normal(size=(len(known), 3)))
    got = tx.score_texts(pa.array(texts), model)
    for i in range(len(texts)):
        at = [int(np.flatnonzero(known == b)[0]) for b in buckets[rows == i] if b in known]
        margin = 0.3 + sum(model.weights[a] for a in at) + sum(model.factors[a] @ model.factors[b] for n, a in enumerate(at) for b in at[n + 1 :])
        assert math.isclose(got[i], 1 / (1 + math.exp(-margin)), rel_tol=1e-9)


def test_terms_are_words_and_their_first_bytes():
    text = "The IDIOTS été the x1"
    words = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
    want = len(words) + sum(len({w.encode()[:n] for w in words if len(w.encode()) >= n}) for n in tx.STEMS)
    assert len(tx.terms(*utf8(pa.array([text])))[1]) == want


def test_pairs_are_learned(spark):
    """Label 1 needs both words: no single term tells it."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join(rng.sample(["insult"] * a + ["group"] * b + ["alpha", "beta", "gamma"], a + b + 3)), int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = tx.fit(df)
    got = {r.doc_id: r.predicted for r in tx.toxicity(df.drop("label"), model).collect()}
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.97


def test_rows_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "bad bad", 5), (1, "bad bad", 5), (None, "bad", 5), (2, None, 5), (3, "", 5), (4, "good " * 50000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (4, 0), (2, 0), (None, 1), (9, None), (1, 1)], "doc_id long, toxic int")
    model = tx.fit(tx.labelled_sample(docs, labels))
    out = tx.toxicity(docs, model)
    assert out.columns == ["doc_id", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert tx.toxicity(docs.limit(0), model).count() == 0
    nothing = tx.fit(tx.labelled_sample(docs, labels.limit(0)))
    assert {(round(r.score, 9), r.predicted) for r in tx.toxicity(docs, nothing).collect()} == {(round(1 / 3, 9), 0)}


def test_held_out_accuracy(spark):
    from recspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op3_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    hit = [r.predicted for r in scored if r.toxic]
    assert np.mean(hit) > 0.75
    assert np.mean([r.predicted for r in scored if not r.toxic]) < 0.05
