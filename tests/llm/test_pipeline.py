import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp

P = pytest.importorskip("public_tokenizers")
sp = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Documents with copies, near copies, a shared passage, benchmark text, junk, nulls; and the benchmark."""
    rng = random.Random(9)
    de = "der die und nicht ein zu von mit auf für straße über können werden zeit jahr haus wasser".split()
    en = "the of and to in that it was for on with water house year people could between through".split()

    def prose(words, n):
        return " ".join(rng.choice(words) + rng.choice(["", "", "s", "en", str(rng.randint(0, 99))]) for _ in range(n))

    passage = prose(en, 150)
    items = [(i, prose(en, 25)) for i in range(4)]
    rows = [(i, prose(de if i % 3 == 0 else en, 120), "de" if i % 3 == 0 else "en", "web", 0) for i in range(30)]
    rows += [(40, rows[1][1], "en", "web", 0), (41, rows[1][1].upper(), None, "web", 0), (42, rows[4][1].replace(" ", "\n"), "en", "web", 0)]
    rows += [(50 + i, prose(en, 60) + " " + passage + " " + prose(en, 60), "en", "web", 0) for i in range(3)]
    rows += [(60, prose(en, 50) + " " + items[2][1] + " " + prose(en, 50), "en", "web", 0), (61, "12 34 !!", "en", "web", 0), (62, None, "en", "web", 0), (63, "", None, None, None)]
    rows += [rows[2], (None, prose(en, 100), "en", "web", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def expected(rows, items):
    """The stages one after the other by brute force (language ID: what surely has one)."""
    from test_simhash import classes, fingerprint

    docs = list(dict.fromkeys(r[:2] for r in rows if re.search("[a-z]", r[1] or "", re.I)))
    prints = {r: fingerprint(r[1]) for r in docs}
    root = classes(sorted(set(prints.values())), 2)
    least = {}
    for r in docs:
        if r[0] is not None:
            least[root[prints[r]]] = min(r[0], least.get(root[prints[r]], r[0]))
    docs = [r for r in docs if least.get(root[prints[r]]) == r[0]]
    counts = Counter(r[1].encode()[i : i + 400] for r in docs for i in range(len(r[1].encode()) - 399))
    cut = []
    for key, text in docs:
        t, gone = text.encode(), set()
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone |= set(range(i, i + 400))
        cut.append((key, bytes(b for i, b in enumerate(t) if i not in gone).decode("utf-8", "ignore")))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(len(words(t)) - 9)}
    return {(k, t) for k, t in cut if not any(tuple(words(t)[i : i + 10]) in windows for i in range(len(words(t)) - 9))}


def test_run_equals_brute_force(spark, made):
    folder, rows, items = made
    library = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = expected(rows, items)
    got = cp.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.token_ids) for r in got) == sorted((str(k), library.encode(t)) for k, t in want)
    assert all(r.round_trip and r.lang for r in got)
    ids = {r.doc_id for r in got}
    assert {1, 2, 4, 50, 51, 52} <= ids and not ids & {40, 41, 42, 60, 61, 62, 63}


def test_stages_keep_columns_and_take_empty_tables(spark, made):
    folder, _, _ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    nothing = docs.limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, nothing, folder)
        assert out.columns == docs.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, nothing, folder).count() == 0
