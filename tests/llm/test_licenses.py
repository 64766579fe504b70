import random
import re
from collections import Counter

import pytest

from recspark.llm import licenses as lc
from recspark.llm.license_texts import TEMPLATES


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return Counter(zip(words[:-1], words[1:], strict=True))


def brute(text, templates, least):
    """Best coefficient of each license over lines, blocks and the whole text."""
    lines = (text or "").split("\n")
    blocks, held = [], []
    for line in [*lines, ""]:
        if re.search(r"[0-9A-Za-z]|[^\x00-\x7F]", line):
            held.append(line)
        elif held:
            blocks.append("\n".join(held))
            held = []
    best = {}
    for part in {*lines, *blocks, text or ""}:
        a = bag(part)
        for name, template in templates:
            b = bag(template)
            if a and b:
                dice = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                if dice >= least:
                    best[name] = max(best.get(name, 0), dice)
    return sorted(((round(-d, 12), n) for n, d in best.items()))


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_equals_brute_force(spark, least):
    rng = random.Random(1)
    sources = [t for _, t in TEMPLATES]
    rows = []
    for _ in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(sources).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 8))):
                words[rng.randrange(len(words))] = rng.choice(["the", "x", "License"])
            parts.append(" ".join(words[rng.randint(0, 2) :]))
            parts.append(rng.choice(["\n", "\n\n", "\n - \n", " "]))
        rows.append("".join(parts))
    rows += [None, "", "MIT", "\n\n", *sources, sources[4].replace("\n", " ").upper()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)] + [(0, rows[0], None)], "doc_id long, text string, licenses string")
    out = lc.scan(df, least=least)
    assert out.columns == ["doc_id", "licenses"]
    found = out.collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert [(round(-x.dice, 12), x.license) for x in r.licenses] == brute(rows[r.doc_id], TEMPLATES, least)
        assert all(0 <= x["from"] < x["to"] <= len((rows[r.doc_id]).encode()) for x in r.licenses)
    assert lc.scan(df.limit(0)).count() == 0
    assert lc.scan(df, texts=()).where("size(licenses) > 0").count() == 0


def test_long_text_and_query(spark):
    from recspark.llm.queries import QUERIES

    text = "word " * 200000 + "\nReleased under the MIT License.\n" + "x\n" * 50000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [x.license for x in lc.scan(df).first().licenses] == ["MIT"]
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_license_scan"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id], TEMPLATES, lc.LEAST)
        assert (r.licenses, r.n_licenses) == (",".join(n for _, n in want), len(want))
    assert any(r.license for r in rows)
