import random

import numpy as np
import pyarrow as pa
import pytest

from recspark.llm.common import utf8
from recspark.llm.token_counts import TOKENIZER, count_tokens, token_counts, tokenizer

P = pytest.importorskip("public_tokenizers")


def whole(texts):
    encode, _ = tokenizer(P.path(TOKENIZER))
    return [len(x) for x in encode.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library_on_odd_texts():
    rng = random.Random(1)
    parts = ["the", "can't", "we'll", " ", "  ", "\n", "\t", " \n", " ", " ", "　", "é", "ß", "日本", "한국", "😀", "<|endoftext|>",
             "12", "3.5", "***", "a", "B", "'", "'s", "-", "ñ", "¡", "\u0085", " ", "é", "0", "…", "x" * 70, "\x00", "\x1c"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    data, offsets = utf8(pa.array(texts))
    assert count_tokens(data, offsets, P.path(TOKENIZER)).tolist() == whole(texts)
    data, offsets = utf8(pa.array(texts[:50]))  # remembered pieces count alike
    assert count_tokens(data, offsets, P.path(TOKENIZER), 10).tolist() == whole(texts[:50])


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 1, "k"), (1, "", 2, None), (None, "ab cd", 3, "k"), (2, "ab cd", 4, "k"), (2, "ab cd", 4, "k"), (3, "long " * 60000, 0, "")],
                               "doc_id long, text string, n_tokens int, key string")
    got = sorted((tuple(r) for r in token_counts(df, P.path(TOKENIZER)).collect()), key=str)
    n = whole(["ab cd", "long " * 60000])
    assert got == sorted([(1, 0, 0), (1, 0, 0), (None, 5, n[0]), (2, 5, n[0]), (2, 5, n[0]), (3, 300000, n[1])], key=str)
    assert token_counts(df.limit(0), P.path(TOKENIZER)).count() == 0
    assert np.array_equal(count_tokens(*utf8(pa.array([], pa.string())), P.path(TOKENIZER)), [])
