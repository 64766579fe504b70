import math

import pytest
from world import catalogue, model, view

from recspark.config import FusionWeights, RecConfig
from recspark.operators import recommend as rc
from recspark.operators.candidates import in_radius, sample_order, sample_outside
from recspark.operators.knn import nearest
from recspark.operators.scoring import Catalogue, mmr


def run(spark, rows, cfg=RecConfig(), requests=None, cat=None, **kw):
    m = model(spark, rows, cfg)
    reqs = requests if requests is not None else rc.one_request_per_user(m.users)
    recs = rc.recommend(reqs, cat or catalogue(spark), m, cfg, **kw)
    items = {}
    for r in sorted(recs.items.collect(), key=lambda r: (r.request_id, r['rank'])):
        items.setdefault(r.request_id, []).append(r)
    return items, {r.request_id: r for r in recs.diagnostics.collect()}


def filter_world(spark):
    """The fixture world plus three items that carry location tags."""
    base = catalogue(spark)
    extra = {"L1": "AiARLocationBarrack3", "L2": "Barrack 3", "L3": "Far"}
    contents = spark.createDataFrame([(i, i, "", 10, False, None, None, []) for i in extra], base.contents.schema)
    tags = spark.createDataFrame([(i, 0, "location", label, 1.0, f"location:{label}") for i, label in extra.items()], base.tags.schema)
    vectors = spark.createDataFrame([(i, [0.0] * 5 + [1.0]) for i in extra], base.vectors.schema)
    return Catalogue(base.contents.union(contents), base.tags.union(tags), base.vectors.union(vectors))


def test_all_kinds_of_requests_in_one_run(spark):
    rows = (view("likes", "101", 120, "next_button") + view("likes", "102", 120, "next_button")
            + view("mixed", "101", 120, "next_button") + view("mixed", "301", 1, "abandon") + view("mixed", "201", 8, "close_button")
            + view("done", "L1", 120, "next_button") + view("done", "L2", 120, "next_button"))
    none = (None, None, None, None)
    reqs = spark.createDataFrame(
        [("likes", "likes", *none), ("mixed", "mixed", *none), ("ghost", "ghost", *none),
         ("new", "likes", "AiARLocationBarrack3", None, None, None), ("again", "done", "AiARLocationBarrack3", None, None, None),
         ("empty", "likes", "Nowhere", None, None, None), ("near", "mixed", None, 52.7581, 9.9062, 150.0)], rc.REQUEST_SCHEMA)
    items, info = run(spark, rows, RecConfig(final_limit=6), requests=reqs, cat=filter_world(spark))
    ids = {k: [r.content_id for r in v] for k, v in items.items()}
    assert ids["likes"][0] == "103" and not {"101", "102"} & set(ids["likes"])
    assert not {"101", "301", "201"} & set(ids["mixed"])
    assert info["likes"].strategy == "warm" and not info["likes"].cold_start_fallback
    assert items["ghost"] and info["ghost"].strategy == "cold" and info["ghost"].cold_start_fallback
    assert set(ids["new"]) == {"L1", "L2"} == set(ids["again"])
    assert info["again"].seen_fallback and not info["new"].seen_fallback
    assert info["empty"].reason == "empty_filter" and "empty" not in items
    assert info["new"].distractor_missing == "filtered_set_exhausted"
    assert set(ids["near"]) == {"102", "103"}
    assert all("geo" in r.breakdown and r.features[5] > 0 for r in items["near"])
    for rs in items.values():
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        assert len(rs) <= 6 and len({r.content_id for r in rs}) == len(rs)
        for r in rs:
            assert sum(r.breakdown.values()) == pytest.approx(r.relevance_score)
    for name in ("likes", "mixed"):
        odd = [r for r in items[name] if r.role == "distractor"]
        assert len(odd) == 1 and odd[0]["rank"] in (3, 4) and odd[0]["rank"] == info[name].distractor_slot and not odd[0].features


def test_other_distractor_strategy_and_slot(spark):
    cfg = RecConfig(distractor_strategy="unexplored_theme", final_limit=6, distractor_slots=(2,))
    items, info = run(spark, view("u", "101", 120, "next_button"), cfg)
    roles = [r.role for r in items["u"]]
    assert roles.count("distractor") == 1 and roles[1] == "distractor" and len(roles) == 6
    assert info["u"].distractor_slot == 2 and items["u"][1].content_id[0] in "23"


def test_untrained_policy_equals_static_weights(spark):
    from recspark.operators import bandit as bd

    cfg = RecConfig(ranking_mode="bandit", bandit_explore=False, distractor_enabled=False,
                    fusion=FusionWeights(semantic=0.0, tag=1.0, affinity=0.0, recency=0.0))
    items, info = run(spark, view("u", "101", 120, "next_button"), cfg, policy=bd.policy(bd.prior_state(spark, cfg)))
    assert info["u"].ranking == "bandit" and all(r.role == "target" for r in items["u"])
    assert items["u"][0].content_id in {"102", "103"}
    for r in items["u"]:
        assert sum(r.breakdown.values()) == pytest.approx(r.relevance_score)


def test_radius_join_matches_brute_force(spark):
    places = spark.createDataFrame(
        [(f"p{a}_{b}", -89.99 + a * 15.0, -180.0 + b * 30.0 + (a % 3) * 0.01) for a in range(13) for b in range(13)],
        "content_id string, lat double, lon double")
    reqs = spark.createDataFrame(
        [("r1", "u", 0.01, 179.99, 20000.0), ("r2", "u", 89.9, 10.0, 60000.0), ("r3", "u", 45.0, 0.0, 2000000.0)],
        "request_id string, user_id string, lat double, lon double, radius_m double")
    got = {(r.request_id, r.content_id) for r in in_radius(reqs, places).collect()}

    def dist(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))

    want = {(q.request_id, p.content_id) for q in reqs.collect() for p in places.collect() if dist(q.lat, q.lon, p.lat, p.lon) <= q.radius_m}
    assert got == want and want


def test_mmr_orders(spark):
    cat = catalogue(spark)
    cat = Catalogue(cat.contents, cat.tags, spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [1.0, 0.0]), ("c3", [0.0, 1.0])], "content_id string, vec array<double>"))
    scored = spark.createDataFrame([("r", "c1", 0.9), ("r", "c2", 0.85), ("r", "c3", 0.6)], "request_id string, content_id string, final_score double")
    for lam, want in ((1.0, ["c1", "c2", "c3"]), (0.0, ["c1", "c3", "c2"])):
        rows = sorted(mmr(scored, cat, RecConfig(mmr_lambda=lam)).collect(), key=lambda r: r['rank'])
        assert [r.content_id for r in rows] == want


def test_nearest_with_small_blocks_matches_brute_force(spark, monkeypatch):
    import random

    import recspark.operators.knn as knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    rng = random.Random(5)
    items = [(f"i{n:03d}", [rng.gauss(0, 1) for _ in range(5)]) for n in range(100)] + [("zz", [0.0] * 5)]
    queries = [(f"q{n}", [rng.gauss(0, 1) for _ in range(5)], n % 3) for n in range(30)]
    v = spark.createDataFrame(items, "content_id string, vec array<double>")
    q = spark.createDataFrame(queries, "qid string, qvec array<double>, extra int")
    got = {}
    for r in nearest(q, v, 7).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.content_id))

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    for qid, vec, extra in queries:
        want = sorted(items, key=lambda i: (-cos(vec, i[1]), i[0]))[:7 + extra]
        assert [c for _, c in sorted(got[qid])] == [i for i, _ in want]


def test_sample_outside_is_exact(spark):
    cat = catalogue(spark)
    order = sample_order(cat.contents, 3)
    full = [r.content_id for r in sorted(order.collect(), key=lambda r: r.position)]
    keys = spark.createDataFrame([("a",), ("b",)], "request_id string")
    barred = spark.createDataFrame([("a", full[0]), ("a", full[2]), ("a", "other")], "request_id string, content_id string")
    got = {}
    for r in sample_outside(keys, barred, order, 3).collect():
        got.setdefault(r.request_id, []).append((r.draw, r.content_id))
    assert [c for _, c in sorted(got["a"])] == [full[1], full[3], full[4]]
    assert [c for _, c in sorted(got["b"])] == full[:3]
