import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from recspark.llm import repeats as rp
from recspark.llm.suffix_array import common_prefixes, suffix_array


def brute(rows, window):
    """(key, bytes, removed, spans, digest of the rest) by counting every window of every row."""
    counts = Counter()
    texts = [(k, (t or "").encode()) for k, t in rows]
    for _, t in texts:
        counts.update(t[i : i + window] for i in range(len(t) - window + 1))
    out = []
    for k, t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = 1
        keep = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((k, len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return sorted(out, key=str)


def made(rng, n=40):
    letters = "ab cdeéß\n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(20, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 10)
            parts += [p[a : len(p) - rng.randint(0, 10)], "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 300), (101, "ab" * 200), (102, "b" + "a" * 90), (103, "xyz" * 30 + "q"), (104, None), (105, ""), (None, rows[0][1]), (3, rows[0][1])]
    return rows


def test_two_stage_order_equals_plain_sort():
    rng = random.Random(1)
    for _ in range(200):
        depth, letters = rng.choice([3, 5, 8, 20]), rng.choice([b"ab", b"abc", b"aab\xff\x00"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(depth, 60))) for _ in range(rng.randint(1, 8))] + [b"a" * rng.randint(depth, 60)] * rng.randint(0, 2)
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        counts = sizes - depth + 1
        order = suffix_array(data, ends - sizes, ends, counts, depth)
        assert sorted(order.tolist()) == [p for a, n in zip(ends - sizes, counts, strict=True) for p in range(a, a + n)]
        keys = [bytes(data[p : p + depth]) for p in order]
        assert keys == sorted(keys)
        shared = common_prefixes(data, order, ends, depth)
        for i in range(1, len(order)):
            assert shared[i] == next((j for j in range(depth) if keys[i - 1][j] != keys[i][j]), depth)


@pytest.mark.parametrize(("seed", "hot", "shard", "piece"), [(0, 512, 1 << 20, 16), (1, 2, 300, 5), (2, 0, 300, 16), (3, 1, 1 << 20, 33)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, hot, shard, piece):
    rows = made(random.Random(seed))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_spans int").repartition(5)
    out = rp.remove_repeats(df, window=40, gram=8, digest=True, hot_runs=hot, shard_bytes=shard, piece=piece)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == brute(rows, 40)
    assert any(0 < r[2] < r[1] for r in got)


def test_stretches_and_run_pieces_change_nothing(monkeypatch):
    monkeypatch.setattr(rp, "RUN", 7)
    data = np.frombuffer(("abcd" * 100 + "".join(random.Random(2).choice("abc") for _ in range(2000))).encode(), np.uint8)
    offsets = np.array([0, 700, 700, len(data)])
    whole, cut = rp.runs(data, offsets, 40, 8), rp.runs(data, offsets, 40, 8, stretch=64)
    windows = [sorted((r, s + i, a) for r, s, n, a in zip(*(x.tolist() for x in part[:4]), strict=True) for i in range(n)) for part in (whole, cut)]
    assert windows[0] == windows[1]
    assert max(whole[2]) <= 7


def test_empty_table_and_text_output(spark):
    df = spark.createDataFrame([(1, "é" * 30 + "tail"), (2, "x" + "é" * 30)], "doc_id long, text string")
    assert rp.remove_repeats(df.limit(0), window=40, gram=8).count() == 0
    assert {r.doc_id: r.kept for r in rp.remove_repeats(df, window=40, gram=8).collect()} == {1: "tail", 2: "x"}


def test_query_equals_brute_force(spark):
    from recspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op2_suffix_array_dedup"](spark, sf).collect()), key=str)
    assert got == brute(rows, 400)


def test_a_passage_in_very_many_documents_makes_few_windows(spark, monkeypatch):
    """All documents share a passage between different texts: its inner pieces fold, only its edges are looked at by windows."""
    rng = random.Random(7)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = prose(150)
    rows = [(i, prose(60) + passage + prose(60)) for i in range(60)]
    made_windows = []
    stored = rp.stored
    monkeypatch.setattr(rp, "stored", lambda df: made_windows.append(out := stored(df)) or out)
    out = rp.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=40, gram=8, digest=True, hot_runs=4)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows, 40)
    windows = [df.count() for df in made_windows if "w1" in df.columns and "at" in df.columns]
    assert len(windows) == 1 and windows[0] <= 60 * 2 * 16  # of 60 * 71 that lie in the passage or cross an edge
