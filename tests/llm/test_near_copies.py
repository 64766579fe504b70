import random

import numpy as np
import pyarrow as pa
import pytest
from test_simhash import classes, fingerprint

import corpus_pipeline as cp
from recspark.llm import near_copies as nc


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("limit", [64, 3])
def test_edited_copies_go(spark, monkeypatch, limit):
    monkeypatch.setattr(nc.similar, "__defaults__", (limit,))
    monkeypatch.setattr(nc, "SAMPLE", 20)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(24):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 150]))]
        for j in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30)) if j else 0):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words), "en", "web", 0))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    prints = {r[0]: fingerprint(r[1]) for r in rows}
    near = classes(sorted(set(prints.values())), 2)
    linked = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    assert sum(near[prints[a]] != near[prints[b]] for a, b in linked) > 20
    assert not [p for p in linked if p[0] in left and p[1] in left]
    root = {a: a for a in sets}
    for _ in sets:
        for a, b in linked | {(a, b) for a in sets for b in sets if a < b and near[prints[a]] == near[prints[b]]}:
            root[a] = root[b] = min(root[a], root[b])
    assert {root[a] for a in left} == set(root.values())
    if limit == 64:
        assert left == set(root.values())


def test_blocks_of_a_large_cell_verify_every_pair(spark, monkeypatch):
    """Cells cut into many blocks, and pivots that link nothing: no pair is lost and no fallback is needed."""
    monkeypatch.setattr(nc, "BLOCK_SHINGLES", 60)
    monkeypatch.setattr(nc, "SAMPLE", 1)
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(90):  # a common start, long enough to be compared, and too little to be similar
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows += [(len(rows) + j, " ".join(shared + own[: 30 - j])) for j in range(2 if i % 3 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = nc.stored(nc.marks(docs))
    node = {r.doc_id: r.node for r in marked.collect()}
    sets = {node[k]: shingles(t) for k, t in rows}
    got = {(r.a, r.b) for r in nc.similar(docs, marked, 5).collect()}
    assert got == {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])} and len(got) == 60


def test_one_id_with_two_texts_and_repeated_rows(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(3, y, "en", 0.25, "k"), (5, x, "en", 0.5, "k"), (5, y, "en", 0.75, "k"), (7, x + " more", "de", 1.0, "k"), (9, "z " * 30, "fr", 2.0, "b"), (9, "z " * 30, "en", 3.0, "a"),
            (None, x, "en", 4.0, "k"), (None, "only " * 9 + "here", "en", 5.0, "k"), (None, None, "en", 6.0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, `a.b` string")
    out = cp.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[5], rows[7], rows[8]], key=str)
    assert sorted(r.score for r in cp.language(spark, docs, "").collect())[:2] == [0.25, 0.5]


def test_a_copy_that_left_with_its_pivot_still_links_others(spark):
    """y is near the first texts and z is near y only, but all their common shingles are full and y leaves them first."""
    base = [f"w{i}" for i in range(120)]
    first = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(6)]
    y, z = (" ".join(base[:n] + [f"{n}x{i}" for i in range(7)]) for n in (106, 99))
    rows = [*first, (50, y), (51, z)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    marked = nc.stored(nc.marks(docs))
    node = {r.doc_id: r.node for r in marked.collect()}
    sets = {node[k]: shingles(t) for k, t in rows}
    pairs = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    assert [p for p in pairs if node[51] in p] == [tuple(sorted((node[50], node[51])))]
    got = {(r.a, r.b) for r in nc.similar(docs, marked, 3).collect()}
    assert got <= pairs
    root = {a: a for a in sets}
    for _ in sets:
        for a, b in got:
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(root.values())) == 1


def test_blocks_get_texts_and_cut_them():
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (24, 20)] + ["", None, None]
    columns = {"cell": [1] * 5, "i": [0] * 5, "j": [0] * 5, "a": [7, 8, 9, 7, 7], "b": [None, None, None, 8, 9], "text": texts}
    kinds = {c: pa.int64() for c in columns} | {"text": pa.string()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in columns.items()], names=list(columns))
    for fifths, pairs in ((4, [(7, 8, 0.8)]), (0, [(7, 8, 0.8), (7, 9, 0.0)])):
        assert [tuple(r.values()) for out in nc._overlaps(fifths)([batch]) for r in out.to_pylist()] == pairs


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 40, 51, 52, 300, 330, 409, 410, 5000, 6000]
    pool = np.unique(rng.integers(0, 1 << 63, 7000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    pool ^= rng.integers(0, 2, len(pool)).astype(np.uint64)
    sets = [np.sort(rng.permutation(pool[: 2 * n + 1])[:n]) for n in sizes]
    first = np.append(0, np.cumsum(sizes))
    words, starts = nc.sketches(np.concatenate(sets), first)
    own = [words[a:b].view(np.uint64) for a, b in zip(starts, starts[1:])]
    assert [len(w) for w in own] == [1, 1, 1, 1, 2, 8, 8, 8, 16, 64, 64]
    for x, s in zip(sets, own):
        for y, t in zip(sets, own):
            n = min(len(s), len(t))
            s_, t_ = (np.bitwise_xor.reduce(w.reshape(-1, n), axis=0) for w in (s, t))
            assert int(np.bitwise_count(s_ ^ t_).sum()) <= len(np.setxor1d(x, y))


def test_sets_that_share_a_passage_only_are_not_sent_to_be_verified(spark, monkeypatch):
    """Pairs of one shingle whose sketches are too far apart never reach a block; the similar ones all do."""
    monkeypatch.setattr(nc, "SAMPLE", 1)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(40):
        words = shared + [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(len(rows) + j, " ".join(words[: 90 - j])) for j in range(2 if i % 4 == 0 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = nc.stored(nc.marks(docs))
    node = {r.doc_id: r.node for r in marked.collect()}
    sets = {node[k]: shingles(t) for k, t in rows}
    pairs = {(a, b) for a in sets for b in sets if a < b and similar(sets[a], sets[b])}
    verify, sent = nc._verified, []

    def counted(texts, marked, pairs, fifths=nc.LINKED):
        if fifths == nc.LINKED:
            sent.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return verify(texts, marked, pairs, fifths)

    monkeypatch.setattr(nc, "_verified", counted)
    assert {(r.a, r.b) for r in nc.similar(docs, marked, 5).collect()} == pairs and len(pairs) == 10
    assert pairs <= set(sent) and len(set(sent)) < 20
