import hashlib
import random
import re

import duckdb
import pytest

from recspark.llm import decontaminate as dc
from recspark.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """(id, words, hit words, items, digest) of every document by comparing each window with each place."""
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for name, body in items:
            b = words(body)
            if not b:
                continue
            size = min(window, len(b))
            wins = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found.add(name)
        ids = sorted(map(str, found - {None}))
        out.append((key, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [6, 1 << 20])
def test_hits_equal_brute_force(spark, block_words):
    rng = random.Random(2)
    vocab = ["a", "B", "été", "x1", "Zz", "42", "ñ", "the"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 16)))) for i in range(12)]
    items += [(3, "the the"), (None, "a"), (20, None), (21, " - "), (22, items[0][1])]
    docs = [(i, rng.choice([", ", " ", "-"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(30)]
    docs += [(100 + i, "zz " + items[i][1] + "!" + items[i][1]) for i in range(12)] + [(None, items[0][1]), (7, None), (7, ""), (7, "")]
    docs += [(500, " ".join(rng.choice(vocab) for _ in range(30000)))]
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = dc.benchmark_hits(df, bench, window=4, block_words=block_words)
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "hits").mapInArrow(
        dc._digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").collect()), key=str)
    assert got == brute(docs, items, 4)
    kept = dc.clean(df, bench, window=4)
    assert kept.columns == ["doc_id", "text", "hits"]
    assert kept.count() == sum(not r[-1] for r in got)
    assert dc.benchmark_hits(df.limit(0), bench).count() == 0
    assert dc.benchmark_hits(df, bench.limit(0)).where("size(hits) > 0").count() == 0


def test_longest_verbatim_match(spark):
    df = spark.createDataFrame([(1, "q a b c d e f z"), (2, "a b c x"), (3, "c d e")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f"), (2, "b c d")], "item_id long, text string")
    got = {(r.doc_id, h.item): (h.at, h.words, h.longest) for r in dc.benchmark_hits(df, bench, window=3).collect() for h in r.hits}
    assert got == {(1, "1"): (1, 6, 6), (1, "2"): (2, 3, 3), (2, "1"): (0, 3, 3), (3, "1"): (0, 3, 3)}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(ORACLES["op5_benchmark_decontamination"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op5_benchmark_decontamination"](spark, sf).collect()) == want
    assert any(r[-1] for r in want)


def test_a_benchmark_text_without_an_id_hits(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three four five six seven eight nine ten eleven"), (4, "other words")], "item_id long, text string")
    assert [r.doc_id for r in dc.clean(df, bench).collect()] == [2]
    assert brute([(1, "one two")], [(None, "two")])[0][2:4] == (1, 0)
