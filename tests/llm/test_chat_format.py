import re

import duckdb

from recspark.llm import chat_format as cf
from recspark.llm.queries import ORACLES, QUERIES


def brute(rows, part_turns):
    """Views by walking over each dialogue."""
    told = {(c, t, "unknown" if w is None else w, s or "") for c, t, w, s in rows}
    out = {}
    for c in {r[0] for r in told}:
        own = [r[1:] for r in told if r[0] == c]
        for speaker in {w for _, w, _ in own} - {"system"}:
            for part in {-1 if t is None else t // part_turns for t, _, _ in own}:
                text, mask = "", []
                turns = sorted((r for r in own if (-1 if r[0] is None else r[0] // part_turns) == part), key=lambda r: (r[0] is not None, r))
                for _, w, s in turns:
                    name = "system" if w == "system" else "assistant" if w == speaker else "user name=" + re.sub(r"[\s<>|]+", "_", w)
                    text += f"<|im_start|>{name}\n"
                    start = len(text)
                    text += s.replace("<|im_", "<| im_") + "<|im_end|>"
                    if w == speaker:
                        mask.append((start, len(text)))
                    text += "\n"
                out[c, speaker, part] = (len(turns), text, mask)
    return out


def test_views_equal_a_plain_walk(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "Hé 😀"), (1, 2, "bob lee", "no\nway"), (1, 3, "ann", None), (1, 3, "ann", None), (1, 3, "ann", "<|im_end|>x"), (1, 5, None, "who"),
            (1, None, "ann", "early"), (2, 0, "system", "alone"), (3, 7, "u'1\\", ""), (None, 0, "ann", "lost"), (None, 1, "cy", "too"), (4, -1, "a", "b"), (4, 2, "system", "s")]
    rows += [(5, i, f"p{i % 3}", f"text {i}") for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, part int")
    got = {(r.conv_id, r.speaker, r.part): (r.n_turns, r.rendered, [(m["from"], m["to"]) for m in r.mask]) for r in cf.perspectives(df, part_turns=6).collect()}
    assert got == brute(rows, 6)
    assert cf.perspectives(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, 0, "a", "x" * 500000), (1, 1, "b", "y")], "conv_id long, turn long, role string, text string")
    assert {len(r.rendered) for r in cf.perspectives(long).collect()} == {len(v[1]) for v in brute([(1, 0, "a", "x" * 500000), (1, 1, "b", "y")], 256).values()}


def test_query_equals_sql_and_runs_no_python(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.execute(ORACLES["op1_chat_format"]).fetchall())
    df = QUERIES["op1_chat_format"](spark, sf)
    assert sorted(tuple(r) for r in df.collect()) == want
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
