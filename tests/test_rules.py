import math

import pytest
from pyspark.sql import functions as F

from recspark.config import RecConfig, patched
from recspark.functions import labels, survey
from recspark.operators import bandit as bd
from recspark.operators import clusters as cl
from recspark.operators import cohort as co
from recspark.operators import search as sr
from recspark.operators import taxonomy as tx


def test_config_patch_is_deep_and_checked():
    cfg = patched(RecConfig(), {"fusion": {"tag": 1.0}, "distractor_slots": [2]})
    assert cfg.fusion.tag == 1.0 and cfg.fusion.semantic == 0.2 and cfg.distractor_slots == (2,)
    with pytest.raises(ValueError):
        patched(RecConfig(), {"nope": 1})


def test_keys_normalise(spark):
    keys = ["THEME_WHAT:Forced Labour", "x:Düsseldorf", "x:Sport  &_Theatre", "x:From: United Kindom", "Straße", "x:“Quoted”"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    got = {r.key: r.nkey for r in labels.with_nkey(df).collect()}
    assert list(map(got.get, keys)) == ["theme_what:forced labor", "x:dusseldorf", "x:sport & theater", "x:from: united kingdom", "strasse", 'x:"quoted"']


def test_demographic_tokens(spark):
    cases = [("gender", "Vrouw.", "female"), ("gender", "", "no_answer"), ("gender", "Magnetron", "other"), ("nationality", "Nederlandse", "dutch"),
             ("nationality", "New Zealand", "new_zealander"), ("age", "select", None), ("personal_connection", "Ik weet het niet.", "unknown"),
             ("age", "---", None)]
    df = spark.createDataFrame([(f, v) for f, v, _ in cases], "field string, value string")
    got = [r.c for r in df.selectExpr(f"{survey.canon_demo_value('field', 'value')} AS c").collect()]
    assert got == [c for _, _, c in cases]


def test_taxonomy_file_and_rules(spark, tmp_path):
    path = tmp_path / "tags.json"
    path.write_text('{"dimensions": [{"key": "theme_what", "main_tags": [{"tag": "Daily Life", "subtags": ["sport/music events", "food"]}]},'
                    '{"key": "person_who", "groups": [{"label": "Age group", "subtags": ["elderly"]}]}, {"key": "medium_what", "subtags": ["map"]}]}')
    index = tx.tag_index(tx.read_terms(spark, str(path)))
    tags = ["Food", "Daily life", "sport events", "Elderly", "Map", "Age 18-24", "AiARLocationBarrack56", "From: Spain", "International", "unheard"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    got = {r.tag: (r.facet, r.label, r.source, r.rollup) for r in tx.assign_facets(df, index).collect()}
    assert got["Food"] == ("theme_what", "food", "subtag", "daily life") and got["sport events"][2] == "subtag"
    assert got["Daily life"] == ("theme_what", "daily life", "exact", None)
    assert got["Elderly"][0] == "person_who.age_group" and got["Map"][0] == "medium_what"
    assert got["Age 18-24"][2] == "pattern" and got["AiARLocationBarrack56"][:3] == ("place_where.camp_areas", "barrack 56", "pattern")
    assert got["From: Spain"][2] == "prefix" and got["International"][2] == "rollup" and got["unheard"][2] == "default"
    assert tx.expand_tags(tx.assign_facets(df, index)).count() == len(tags) + 2


def test_bandit_prior_weights_and_half_updates(spark):
    cfg = RecConfig()
    theta = bd.policy(bd.prior_state(spark, cfg)).first().theta
    assert theta == pytest.approx([0.2, 0.1, 0.45, 0.05, -0.3, 0.2])
    rows = spark.createDataFrame([([1.0, 0.5, 0.0, 0.2, 0.0, 0.0], 1.0)] * 40, "features array<double>, reward double")
    once = bd.train(rows.limit(20), cfg).first()
    halves = bd.train(rows, cfg, weight="0.5D").first()
    assert once.a == pytest.approx(halves.a) and once.b == pytest.approx(halves.b)
    again = bd.train(rows, cfg, start=bd.train(rows, cfg)).first()
    assert again.n_updates == 80 and again.a[0] == pytest.approx(81.0)


def test_auc_with_ties_and_one_class(spark):
    data = [(0.1, False), (0.4, True), (0.4, False), (0.35, True), (0.8, True), (0.8, True)]
    df = spark.createDataFrame(data, "score double, label boolean")
    pos, neg = [s for s, l in data if l], [s for s, l in data if not l]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert bd.auc(df, "auc").first().auc == pytest.approx(want)
    assert math.isnan(bd.auc(df.filter("label"), "auc").first().auc)


def test_clusters_separate_and_memberships(spark):
    rows = []
    for n in range(6):
        theme = "theme_what:a" if n < 3 else "theme_what:b"
        rows += [(f"u{n}", theme, 1.0), (f"u{n}", "theme_how:x", 0.1 * (n % 3))]
    points = spark.createDataFrame(rows, "user_id string, key string, weight double")
    centroids, k = cl.kmeans(points, 2, start=["u0", "u5"])
    got = {r.user_id: r.cluster for r in cl.assign(points, centroids, k).collect()}
    assert len({got[u] for u in ("u0", "u1", "u2")}) == 1 and got["u0"] != got["u3"]
    soft = cl.memberships(points, centroids, k)
    for r in soft.collect():
        assert sum(r.u) == pytest.approx(1.0) and max(r.u) > 0.85
    profile = cl.profiles(cl.assign(points, centroids, k), centroids, k).collect()
    assert sorted(p.size for p in profile) == [3, 3] and all(p.falk_hint == "Hobbyist-like (narrow)" for p in profile)
    assert cl.spread_start(points, 2, seed=1)[0] != cl.spread_start(points, 2, seed=1)[1]


def test_search_text_helpers(spark):
    row = spark.range(1).selectExpr(
        f"{sr.highlight(repr('Hello world'), repr('hell'))} AS a", f"{sr.highlight(repr('hello world'), repr('ello'))} AS b",
        f"{sr.highlight(repr('cost (a+b)'), repr('cost (a'))} AS c", f"{sr.limit_text(repr('hello world'), 5)} AS d").first()
    assert (row.a, row.b, row.c, row.d) == ("<b>Hell</b>o world", "hello world", "<b>cost (a</b>+b)", "hello...")


def test_facets_against_brute_force(spark):
    assert co.parse_ranges("boring:4-5,interest:1-2,bad") == {"boring": (4, 5), "interest": (1, 2)}
    people = [("a", "25_34", "female", "dutch"), ("b", "25_34", "male", "german"), ("c", "18_24", "female", "german"), ("d", None, None, "dutch")]
    cols = "user_id string, age string, gender string, nationality string"
    demo = spark.createDataFrame(people, cols).selectExpr("*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("province", "personal_connection", "email_shared")])
    filters = {"gender": {"female"}, "nationality": {"dutch", "german"}, "age": {"25_34"}}
    match = co.matched(demo.select("user_id"), demo, None, filters, {})
    got = {(r.field, r.value): r.visitors for r in co.faceted_counts(match, filters).collect()}
    assert got == {("age", "25_34"): 1, ("age", "18_24"): 1, ("gender", "female"): 1, ("gender", "male"): 1, ("nationality", "dutch"): 1}
    assert match.filter("fails = 0").count() == 1


def test_survey_merge_prefers_plain_keys(spark):
    rows = [("u", 1, 1, {"q:interest": ["Eens"], "interest": ["4"], "q:memorable": [" ​the end "], "email": ["a@b.c"], "boring": ["​"]})]
    df = spark.createDataFrame(rows, "user_id string, ts int, event_id int, survey_answers map<string,array<string>>")
    got = {r.base: (r.section, r.labels, r.score) for r in survey.split_answers(df).collect()}
    assert got == {"interest": ("feedback", ["Agree"], 4), "memorable": ("feedback", ["the end"], None)}
    assert F is not None


def test_evaluation_stores_no_columns_it_does_not_read(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(bd, "materialize", lambda df: kept.append(set(df.columns)) or df)
    rows = [(f"s{i}", f"wide {i}", [float(i % 5 == j) for j in range(6)], i % 3 - 1.0) for i in range(40)]
    samples = spark.createDataFrame(rows, "session string, request_id string, features array<double>, reward double")
    assert bd.evaluate(samples, RecConfig(), "session").first().samples == 8
    assert kept[0] == {"features", "reward", "holdout"}
