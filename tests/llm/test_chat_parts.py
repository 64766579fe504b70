from recspark.llm import chat_format as cf


def test_overfull_parts_are_cut(spark):
    rows = [(None, None, "ann" if i % 2 else "bob", f"n{i:03}") for i in range(50)]
    rows += [(1, i % 3, "ann", f"t{i:03}") for i in range(40)] + [(1, 9, "cy", "late"), (2, 0, "ann", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.part): r for r in cf.perspectives(df, part_turns=8).collect()}
    assert all(r.n_turns <= 8 for r in got.values())
    for conv, speaker, part, own in [(None, "ann", -1, rows[:50]), (1, "cy", 0, rows[50:90])]:
        pieces = [got[conv, speaker, part + (n << 48)] for n in range(-(-len(own) // 8))]
        assert sum(r.n_turns for r in pieces) == len(own)
        said = [x.split("<|im_end|>")[0] for r in pieces for x in r.rendered.split("\n")[1::2]]
        assert said == [r[3] for r in sorted(own, key=lambda r: (r[1] or 0, r[2], r[3]))]
        assert [r.rendered[m["from"] : m["to"]] for r in pieces for m in r.mask] == [f"{r[3]}<|im_end|>" for r in sorted(own, key=lambda r: (r[1] or 0, r[2], r[3])) if r[2] == speaker]
    assert got[1, "ann", 1].n_turns == 1 and got[2, "ann", 0].n_turns == 1
