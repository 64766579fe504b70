import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from recspark.llm.crc import crc32_spans
from recspark.llm.importance import resample

ODD = ["Straße", "ÄRGER", "日本", "x" * 300, "w" * 1500, "a1b2", "THE", "the"]


def test_crc_equals_zlib_at_every_length():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(120000), np.uint8)
    sizes = [*range(0, 520), 767, 768, 769, 4096, 65535, 65536, 65537, 110000] * 3
    starts = np.array([rng.randrange(0, 120000 - n + 1) for n in sizes])
    got = crc32_spans(data, starts, starts + np.array(sizes))
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts.tolist(), sizes, strict=True)]
    assert crc32_spans(data, np.zeros(0, int), np.zeros(0, int)).tolist() == []


def features(text, ngrams):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
    return len(words), [b" ".join(words[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, ngrams=(1, 1), m=10000, least=20, percent=10, seed="2024"):
    s = Counter(zlib.crc32(f) % m for _, t in docs for f in features(t, ngrams)[1])
    t = Counter(zlib.crc32(f) % m for x in target for f in features(x, ngrams)[1])
    of_s, of_t = sum(s.values()) + m, sum(t.values()) + m
    out = []
    for key, text in docs:
        n, fs = features(text, ngrams)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in (zlib.crc32(f) % m for f in fs))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def sample():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ODD
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 25, 60])))) for i in range(300)]
    docs += [(500, None), (501, ""), (None, "no id " * 15), (None, None), (7, "seven again " * 12), (7, "seven again " * 12), (502, "long one " * 30000)]
    return docs, [" ".join(rng.choices(vocabulary[:10], k=30)) for _ in range(20)] + [None, ""]


def test_draw_equals_plain_for_words_and_runs(spark):
    docs, target = sample()
    df = spark.createDataFrame([(k, t, 1, "c") for k, t in docs], "doc_id long, text string, weight int, key string").repartition(5)
    goal = spark.createDataFrame([(t, 0) for t in target], "text string, doc_id int")
    got = resample(df, goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target)
    runs = resample(df, goal, ngrams=(1, 3), buckets=997, least_words=5, percent=40, seed="it's")
    assert sorted((tuple(r) for r in runs.collect()), key=str) == plain(docs, target, (1, 3), 997, 5, 40, "it's")


def test_target_like_documents_are_drawn(spark):
    rng = random.Random(5)
    near, far = [f"n{i}" for i in range(30)], [f"f{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(near if i % 10 == 0 else far, k=40))) for i in range(400)]
    got = resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(" ".join(near),)] * 20, "text string"))
    drawn = [r.doc_id for r in got.collect() if r.rank is not None]
    assert len(drawn) == 40 and sum(d % 10 == 0 for d in drawn) >= 38


def test_empty_tables(spark):
    docs, target = sample()
    none, goal = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample(none, goal).collect() == []
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in resample(df, goal).collect()), key=str) == plain(docs, [])
