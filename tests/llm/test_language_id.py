import math

import numpy as np
import pyarrow as pa

from recspark.llm import language_id as li


def grams(text):
    """Code by code: the folded text after two blanks, n-grams by their last character, blank ones left out."""
    fold = li._letters()
    codes = [32, 32] + [int(fold[ord(c)]) for c in text]
    for order in li.ORDERS:
        for end in range(2, len(codes)):
            g = codes[end - order + 1 : end + 1]
            if any(c != 32 for c in g):
                yield int(li.gram_buckets(np.array(g, np.uint32), order)[0])


def test_scores_equal_a_plain_naive_bayes(monkeypatch):
    monkeypatch.setattr(li, "BLOCK", 7)
    rng = np.random.RandomState(0)
    model = li.LanguageModel(["a", "b"], np.log([0.3, 0.7]), rng.normal(0, 0.1, (2, 1 << li.BUCKET_BITS)).astype(np.float32))
    texts = ["Der Hund", "", None, "12 + 3", "été à l'école", "x", "ß" * 30, "a\nb"]
    languages, score = li.score_texts(pa.array(texts), model)
    for text, lang, s in zip(texts, languages, score, strict=True):
        g = list(grams(text or ""))
        if not g:
            assert (lang, s) == ("und", 0)
            continue
        sums = [model.prior[i] + sum(float(model.weights[i][b]) for b in g) for i in (0, 1)]
        best = int(sums[1] > sums[0])
        assert lang == model.languages[best]
        assert math.isclose(s, 1 / sum(math.exp(x - max(sums)) for x in sums), abs_tol=1e-5)


def test_fit_counts_all_rows_and_predicts(spark):
    rows = [(i, "der hund und die katze", "de", "x") for i in range(6)] + [(i, "the dog and the cat", "en", "x") for i in range(10, 14)]
    rows += [(None, "the cat", "en", None), (20, None, "de", None), (21, "katze", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = li.fit(df)
    assert model.languages == ["de", "en"]
    assert math.isclose(math.exp(model.prior[0]), 6 / 11)
    counts = np.bincount(list(grams("der hund und die katze")) * 6, minlength=1 << li.BUCKET_BITS)
    assert np.allclose(model.weights[0], np.log((counts + li.SMOOTHING) / (counts.sum() + li.SMOOTHING * (1 << li.BUCKET_BITS))), atol=1e-5)
    got = {(r.doc_id, r.lang_pred) for r in li.identify(df, model).collect()}
    assert got == {(i, "de") for i in range(6)} | {(i, "en") for i in range(10, 14)} | {(None, "en"), (20, "und"), (21, "de")}
    nothing = li.fit(df.limit(0))
    assert {r.lang_pred for r in li.identify(df, nothing).collect()} == {"und"}
    assert li.identify(df.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.fit(docs.where(~li.held_out("doc_id", 3, 1)))
    rows = li.identify(docs.where(li.held_out("doc_id", 3, 1)), model).select("lang", "lang_pred").collect()
    assert len(rows) > 30
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
