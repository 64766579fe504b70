import random
import re

import numpy as np
import pyarrow as pa
from test_licenses import bag

from recspark.llm import licenses as lc
from recspark.llm.common import utf8
from recspark.llm.license_texts import TEMPLATES


def test_equals_all_runs_of_words():
    rng = random.Random(3)
    templates = (("A", "a b c d e f g"), ("B", "b c b c b c"), ("C", "g a"))
    texts = [" ".join(rng.choice("abcdefgxy") for _ in range(rng.randint(0, 25))) for _ in range(150)] + [None, "a b c d\n\n *\n * E, f g x"]
    for least in (0.5, 0.8):
        best = {}
        for r, _, _, t, d in zip(*(x.tolist() for x in lc.passages(*utf8(pa.array(texts)), lc.index_templates(templates), least)), strict=True):
            best[r, t] = max(best.get((r, t), 0), round(d, 9))
        want = {}
        for r, text in enumerate(texts):
            words = re.findall("[a-z]", (text or "").lower())
            for t, (_, template) in enumerate(templates):
                b = bag(template)
                runs = [bag(" ".join(words[i:j])) for i in range(len(words)) for j in range(i + 2, len(words) + 1)]
                d = max((2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) for a in runs), default=0)
                if d >= least:
                    want[r, t] = round(d, 9)
        assert best == want


def test_notices_inside_longer_texts(spark, tmp_path):
    rng = random.Random(8)
    body = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    rows, names = [], []
    for name, text in TEMPLATES:
        sentences = re.sub(r"(?<=[.:;])\s+", "\n *\n * ", text)
        for made in (f"{body(120)}\n\n{sentences}\n\n{body(120)}", f"{body(60)} {text} {body(60)}"):
            rows.append((len(rows), made))
            names.append(name)
    spark.createDataFrame([*rows, (len(rows), body(200))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lc.op6_license_scan(spark, str(tmp_path)).collect()}
    for (i, _), name in zip(rows, names, strict=True):
        assert name in got[i].licenses.split(",") and np.isclose(got[i].dice, 1)
    assert got[len(rows)].n_licenses == 0
