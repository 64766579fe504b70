import hashlib
import random

import pytest

from recspark.llm import sentencepiece_codec as sc

P = pytest.importorskip("public_tokenizers")
sp = pytest.importorskip("sentencepiece")


def texts():
    rng = random.Random(0)
    parts = ["the", "can't", " ", "  ", "\n", "\t", "é", "ß", "日本語", "한국", "😀", "<s>", "12", "3.14", "***", "aaaaaaa", "▁", "x" * 30, "\x00", "indivisible", "ñandú", "    ", " if"]
    out = ["", "a", " ", "   "] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600)]
    return out + ["".join(rng.choice("abcdeinotrs ▁") for _ in range(rng.randint(1, 40))) for _ in range(1000)]


def test_ids_and_texts_equal_the_library(monkeypatch):
    library = sp.SentencePieceProcessor(model_file=P.path(sc.MODEL))
    coder = sc.Codec(P.path(sc.MODEL))
    for bound in (sc.MEMORY, 50):  # what is remembered or forgotten changes nothing
        monkeypatch.setattr(sc, "MEMORY", bound)
        coder.pairs.bound = bound
        some = texts()
        ids, offsets = coder.encode(some)
        got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        assert got == library.encode(some)
        assert coder.decode(ids, offsets) == [library.decode(x) for x in got]


def test_rows_nulls_and_long_texts(spark):
    library = sp.SentencePieceProcessor(model_file=P.path(sc.MODEL))
    rows = [(1, None, 0), (1, "", 0), (None, "two words", 0), (2, "two words", 0), (2, "two words", 0), (3, "long été " * 40000 + "a" * 3000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = sc.decode(sc.encode(df, P.path(sc.MODEL)), P.path(sc.MODEL)).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in out) == sorted((str(k), t or "") for k, t, _ in rows)
    assert all(r.token_ids == library.encode(r.text or "") for r in out)
    assert sc.encode(df.limit(0), P.path(sc.MODEL)).count() == 0


def test_query_equals_the_library(spark):
    from recspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    library = sp.SentencePieceProcessor(model_file=P.path(sc.MODEL))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        text = library.decode(ids)
        assert (r.token_ids, r.n_tokens, r.decoded_sha256, r.round_trip) == (ids, len(ids), hashlib.sha256(text.encode()).hexdigest(), text == docs[r.doc_id])
