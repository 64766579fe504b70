import random

import numpy as np

from recspark.operators import knn


def test_many_blocks_and_slices_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "SLICE_ROWS", 7)
    rng = random.Random(3)
    items = [(f"i{n:03d}", [float(rng.randint(-3, 3)) for _ in range(4)]) for n in range(150)] + [(f"z{n}", [0.0] * 4) for n in range(30)]
    items += [(f"d{n:02d}", items[5][1]) for n in range(60)] + [("none", None)]
    asked = [(f"q{n}", [float(rng.randint(-3, 3)) for _ in range(4)], n % 3) for n in range(20)] + [("zero", [0.0] * 4, 0), ("null", None, 0)]
    vectors = spark.createDataFrame(items, "content_id string, vec array<double>")
    queries = spark.createDataFrame(asked, "qid string, qvec array<double>, extra int")
    got = {}
    for r in knn.nearest(queries, vectors, 5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.content_id, round(r.score, 9)))

    def unit(v):
        v = np.array(v)
        n = np.sqrt((v * v).sum())
        return v / n if n else v

    known = [(i, unit(v)) for i, v in items if v is not None]
    for q, v, extra in asked:
        if v is None:
            assert q not in got
            continue
        want = sorted(((-round(float(unit(v) @ u), 9) + 0.0, i) for i, u in known))[: 5 + extra]
        assert sorted(got[q]) == [(n + 1, i, -s + 0.0) for n, (s, i) in enumerate(want)]
    # a zero vector ties with all items, and still each pair of block and query gives k rows
    pairs = knn.nearest(queries.filter("qid = 'zero'").drop("extra"), vectors, 3)
    assert [r.content_id for r in sorted(pairs.collect(), key=lambda r: r["rank"])] == sorted(i for i, _ in known)[:3]
