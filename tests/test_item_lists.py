import math

import pytest

from recspark.config import RecConfig
from recspark.operators import item_lists, scoring
from recspark.operators import signals as sg
from recspark.operators.scoring import Catalogue, mmr, vector_scores

VECTORS = {"a": [[3.0, 4.0, 0.0]], "b": [[0.0, 2.0, 1.0], [1.0, 0.0, 0.0]], "c": [[0.0, 0.0, 0.0]], "d": [[1.0, 1.0, 1.0]], "e": [None], "f": [[-1.0, 0.5, 0.0]]}


def sent(df, metric, kind=""):
    """A metric of the shuffles of a table that was collected."""
    found, rest = [], [df._jdf.queryExecution().executedPlan()]
    while rest:
        node = rest.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            rest.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            rest.append(node.plan())
        else:
            children = node.children()
            rest += [children.apply(i) for i in range(children.size())]
        if name == "ShuffleExchangeExec" and kind in node.simpleString(1000):
            found.append(node.metrics().apply(metric).value())
    return found


def cosine(a, b):
    na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0


def catalogue(spark):
    rows = [(i, v) for i, vs in VECTORS.items() for v in vs]
    return Catalogue(None, None, spark.createDataFrame(rows, "content_id string, vec array<double>"))


def test_scores_of_lists_in_many_blocks_match_brute_force(spark, monkeypatch):
    """Repeated and unknown ids, ids with two vectors, a like without a vector, and likes in several chunks."""
    monkeypatch.setattr(item_lists, "LEAST_IDS", 3)
    monkeypatch.setattr(scoring, "LIKED_CHUNK", 2)
    lists = {("r1", "u"): ["a", "b", "x"], ("r2", "u"): ["c", "d", "d"], ("r3", "v"): ["e", "f", "a"], ("r4", None): ["a", None], ("r5", "w"): ["x"]}
    likes = {"u": {"a": 2.0, "d": 1.0, "f": 0.5, "e": 4.0, "y": 3.0}, "v": {"b": 0.25, "e": 0.5}, "w": {"a": 0.0}}
    taste, recency = {"u": [1.0, 0.0, 2.0], "w": [1.0, 1.0, 1.0]}, {"u": [0.0, 1.0, 0.0], "v": [1.0, 2.0, 3.0]}
    candidates = spark.createDataFrame([(r, u, i) for (r, u), ids in lists.items() for i in ids], "request_id string, user_id string, content_id string")
    positives = spark.createDataFrame([(u, i, w) for u, held in likes.items() for i, w in held.items()], "user_id string, content_id string, weight double")
    profile = [spark.createDataFrame(list(t.items()), f"user_id string, {name} array<double>") for name, t in (("taste", taste), ("recency", recency))]
    got = vector_scores(candidates, catalogue(spark), *profile, positives).collect()

    def score(side, user, vec):
        return (cosine(side[user], vec) + 1) / 2 if vec and user in side else 0.0

    def affinity(user, item):
        held = {i: w for i, w in likes.get(user, {}).items() if w > 0}
        pairs = [(cosine(a, b) + 1) / 2 * w / max(held.values()) for a in VECTORS.get(item, []) if a for i, w in held.items() for b in VECTORS.get(i, []) if b]
        return max(pairs, default=0.0)

    want = [(r, u, i, score(taste, u, v), affinity(u, i), score(recency, u, v)) for (r, u), ids in lists.items() for i in ids for v in VECTORS.get(i, [None])]
    order = [str((*x[:3], *(round(y, 9) + 0.0 for y in x[3:]))) for x in want]
    assert sorted(order) == sorted(str((x.request_id, x.user_id, x.content_id, *(round(y, 9) + 0.0 for y in (x.semantic, x.affinity, x.recency)))) for x in got)


def test_a_block_gets_each_vector_once(spark):
    lists = spark.createDataFrame([(f"r{n}", ["a", "b", "c"], ["a", None, "zz"] if n % 2 else None) for n in range(200)], "request_id string, ids array<string>, liked array<string>")
    marked, items = item_lists.dealt(lists, ["request_id"], ["ids", "liked"], catalogue(spark))
    assert marked.count() == 200
    assert sorted((r.block, r.content_id, len(r.known), len(r.flat)) for r in items.collect()) == [(0, "a", 1, 3), (0, "b", 2, 6), (0, "c", 1, 3)]


def test_blocks_are_bounded():
    assert item_lists.block_count(0, 0, 0, 8) == 1
    assert item_lists.block_count(10, 500, 2_000, 8) == 1
    assert item_lists.block_count(15_000, 1_200_000, 2_000, 8) == 32
    assert item_lists.block_count(540_000, 43_000_000, 2_000, 8) == 42
    assert item_lists.block_count(540_000, 43_000_000, 720_000, 8) == -(-43_000_000 // item_lists.BLOCK_ITEMS)
    assert item_lists.block_count(1_000_000, 1_000_000, 2_000, 1) == -(-1_000_000 // item_lists.BLOCK_LISTS)


def test_order_with_repeated_scores_and_unknown_items(spark, monkeypatch):
    monkeypatch.setattr(item_lists, "LEAST_IDS", 2)
    rows = [("r", "b", 0.9), ("r", "x", 0.9), ("r", "a", 0.8), ("s", "x", 0.1), ("s", "y", 0.2), ("t", "f", -1.0)]
    scored = spark.createDataFrame(rows, "request_id string, content_id string, final_score double")
    got = {}
    for r in sorted(mmr(scored, catalogue(spark), RecConfig(mmr_lambda=1.0, final_limit=3)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request_id, []).append((r["rank"], r.content_id))
    assert got == {"r": [(1, "b"), (2, "b"), (3, "x")], "s": [(1, "y"), (2, "x")], "t": [(1, "f")]}
    # Of two vectors with one score the lower one is first; the other is then as far away as the unknown item.
    assert [r.content_id for r in sorted(mmr(scored.filter("request_id = 'r'"), catalogue(spark), RecConfig(mmr_lambda=0.5)).collect(), key=lambda r: r["rank"])][0] == "b"


def test_vectors_do_not_travel_with_each_candidate(spark):
    rows = spark.range(12_000).selectExpr("CAST(id div 30 AS STRING) AS request_id", "CAST(id div 30 AS STRING) AS user_id", "CAST(id % 30 AS STRING) AS content_id")
    vectors = spark.range(30).selectExpr("CAST(id AS STRING) AS content_id", "transform(sequence(1, 64), x -> sin(id * 64 + x)) AS vec")
    likes = rows.selectExpr("user_id", "content_id", "1D AS weight")
    taste = rows.select("user_id").distinct().selectExpr("user_id", "transform(sequence(1, 64), x -> 1D) AS taste")
    cat = Catalogue(None, None, vectors)
    scores = vector_scores(rows, cat, taste, taste.selectExpr("user_id", "taste AS recency"), likes)
    order = mmr(scores.selectExpr("request_id", "content_id", "semantic AS final_score"), cat, RecConfig())
    for df, n in ((scores, 12_000), (order, 4_000)):
        assert len(df.collect()) == n
        assert sum(sent(df, "dataSize")) < 12_000 * 64 * 8 / 4


def test_few_partial_sums_of_a_key_are_sent(spark):
    likes = spark.range(0, 4_000, 1, 16).selectExpr("CAST(id % 20 AS STRING) AS user_id", "CAST(id % 7 AS STRING) AS content_id", "1D AS weight")
    vectors = spark.range(7).selectExpr("CAST(id AS STRING) AS content_id", "array(id + 1D, 2D) AS vec")
    out = sg.weighted_centroid(likes, vectors, ["user_id"], "weight", "taste")
    assert len(out.collect()) == 20
    assert sent(out, "shuffleRecordsWritten", "hashpartitioning(user_id") == [20]
