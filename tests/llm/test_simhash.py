import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from recspark.llm import simhash as sh
from recspark.llm.common import utf8
from recspark.llm.xxh64 import xxh64


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(points, radius):
    root = {p: p for p in points}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in points:
        for b in points:
            if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {p: top(p) for p in points}


def test_xxh64_equals_the_library():
    rng = np.random.RandomState(0)
    data = rng.randint(0, 256, 3000).astype(np.uint8)
    starts = rng.randint(0, 2800, 500)
    ends = starts + np.r_[np.arange(150), rng.randint(0, 190, 350)]
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64(data[a:b].tobytes(), seed=42).intdigest() for a, b in zip(starts, ends, strict=True)]


def test_fingerprints_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(sh, "SHINGLES_AT_ONCE", 5)
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "a B", "a\tb\x0bc", "x\x85y  z q", "é É ñ " * 20, "word " * 50]
    texts += ["".join(rng.choice("aB é\n\t ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    assert sh.fingerprints(*utf8(pa.array(texts))).tolist() == [fingerprint(t) for t in texts]


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    points = {0, 1, 3, (1 << 64) - 1, 1 << 63}
    for c in centres:
        for _ in range(60):
            p = c
            for _ in range(rng.randint(0, 5)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = classes(sorted(signed), 2)
    for limit in (3, 10_000):  # the way of full cells, and that of the others
        edges = [(r.a, r.b) for r in sh.links(df, cell_limit=limit).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in edges)
        found = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {p: found.get(p, p) for p in signed} == want


def test_near_duplicates_rows_and_nulls(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base, "x"), (3, base, "x"), (3, base, None), (9, base.replace("w7 ", "W7\n"), "x"), (1, "quite another text", "x"),
            (8, None, "x"), (7, "", "x"), (None, base, "x"), (None, "alone here now", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in sh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (9, 3), (1, 1), (8, 7), (7, 7), (None, 3), (None, None)], key=str)
    assert sh.near_duplicates(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from recspark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in docs}
    root = classes(sorted(set(prints.values())), 2)
    least = {}
    for d, p in prints.items():
        least[root[p]] = min(d, least.get(root[p], d))
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op8_simhash_dedup"](spark, sf).collect()}
    assert got == {(d, f"{p:016x}", least[root[p]]) for d, p in prints.items()}
