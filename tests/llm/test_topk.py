import math
import random

import duckdb
import pytest

from recspark.llm import topk as tk
from recspark.llm.queries import ORACLES, QUERIES


def brute(rows, top, is_query):
    kept = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in kept:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in kept if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:top])]
    return sorted(out)


@pytest.mark.parametrize("bins", [7, 512])
def test_equals_brute_force(spark, bins):
    rng = random.Random(0)
    rows = [(i, [round(rng.uniform(-2, 2), 1) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)] + [(200, [0.0, 0.0, 0.0]), (201, None), (202, [1.0, None, 2.0]), (203, [1.0, math.nan, 0.0]), (204, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (205, []), (3, rows[3][1])]
    rows += [(300, [1e5, -1e5, 7e4]), (301, [-1e5, 1e5, 3.0]), (400, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int").repartition(3)
    vectors = tk.quantized(df)
    got = tk.top_k(vectors, vectors.where("id % 10 = 0"), top=4, query_block=5, vector_block=17, bins=bins)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, lambda i: i % 10 == 0)


def test_few_and_no_candidates(spark):
    one = tk.quantized(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert tk.top_k(one, one).count() == 0
    assert tk.top_k(one.limit(0), one.limit(0)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(ORACLES["op4_exact_topk"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op4_exact_topk"](spark, sf).collect()) == want
