import pytest
from pyspark.sql import functions as F
from world import catalogue

from recspark.config import RecConfig
from recspark.operators import evaluation as ev

SCENARIOS = [{"name": "open"}, {"name": "near", "near_lat": 52.7562, "near_lon": 9.9105, "geo_radius_m": 150}]


def personas(spark):
    rows = [("family", "family, children and siblings", None), ("worker", "forced labor", {"age_group": ["25_34"]}), ("walk_in", "", None),
            ("teacher", "a woman of 41 years, liberation", {"gender": ["Other"]})]
    return spark.createDataFrame(rows, "persona string, text string, answers map<string,array<string>>")


def likes(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id string, content_id string")


def test_texts_answers_and_likes_make_a_model(spark):
    model = ev.persona_model(personas(spark), catalogue(spark), likes(spark, ("family", "201"), ("family", "202")))
    keys = {(r.user_id, r.key): r.weight for r in model.tag_affinity.collect()}
    assert keys["family", "theme_what:family"] == pytest.approx(1.0) and ("family", "theme_what:children") in keys and ("worker", "theme_what:forced labor") in keys
    assert not [k for k in keys if k[0] == "walk_in"]
    answers = {r.user_id: r.answers for r in model.personas.collect()}
    assert answers["teacher"] == {"gender": ["Other"], "age_group": ["35_44"]} and answers["worker"] == {"age_group": ["25_34"]}
    assert [(r.user_id, r.taste) for r in model.taste.collect()] == [("family", [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]


def test_lists_of_every_persona_and_scenario(spark):
    cat = catalogue(spark)
    rows = {(r.persona, r.scenario): r for r in ev.evaluate_personas(personas(spark), SCENARIOS, cat, likes(spark, ("family", "201")), RecConfig()).collect()}
    assert len(rows) == 8
    assert rows["family", "open"].n_targets > 0 and rows["family", "open"].avg_target_score > rows["walk_in", "open"].avg_target_score
    # three items lie within the radius; a liked one counts as seen
    assert rows["worker", "near"].n_items == 3 and rows["family", "near"].n_items <= 3
    assert rows["walk_in", "open"].cold_start_fallback and not rows["family", "open"].cold_start_fallback
    verdicts = spark.createDataFrame([("family", 5), ("family", 2), ("worker", 4)], "persona string, score int")
    report = {r.persona: (r.n, r.mean_score, r.share_relevant) for r in ev.relevance_report(verdicts).collect()}
    assert report["family"] == (2, 3.5, 0.5) and report[None][0] == 3


def test_builtin_personas_have_distinct_names(spark):
    names = [r.persona for r in ev.builtin_personas(spark).collect()]
    assert len(names) == len(set(names)) == 8
    assert ev.builtin_personas(spark).filter(F.size("answers") == 0).count() == 2 - 1
