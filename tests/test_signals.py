import pytest
from world import NOW, events, model, view

from recspark.operators import signals as sg


def pairs(df, value="weight", key="content_id"):
    return {r[key]: r[value] for r in df.collect()}


def test_hand_computed_strengths(spark):
    m = model(spark, view("a", "101", 120, "next_button") + view("b", "101", 1, "abandon") + view("c", "101", 8, "close_button")
              + view("d", "101", 120, "next_button", visits=2))
    got = {r.user_id: (round(r.strength, 9), r.outcome) for r in m.signals.collect()}
    assert got == {"a": (0.778693868, "positive"), "b": (-0.064306132, "negative"), "c": (0.134693868, "neutral"),
                   "d": (0.826424112, "positive")}


def test_positive_gives_tags_and_taste(spark):
    m = model(spark, view("u", "101", 120, "next_button") + view("u", "102", 120, "next_button"))
    assert set(pairs(m.positives)) == {"101", "102"}
    affinity = pairs(m.tag_affinity, key="key")
    assert affinity["theme_what:forced labor"] == 1.0 and max(affinity.values()) == 1.0
    taste = m.taste.first().taste
    assert taste[0] == pytest.approx(1.0) and sum(x * x for x in taste) == pytest.approx(1.0)


def test_abandon_gives_aversion_and_decay_lowers_weight(spark):
    m = model(spark, view("u", "201", 1, "abandon") + view("new", "101", 120, "next_button") + view("old", "101", 120, "next_button", hours=1440))
    aversion = {(r.user_id, r.key): r.weight for r in m.tag_aversion.collect()}
    assert aversion[("u", "theme_what:family")] == 1.0
    weights = {r.user_id: r.weight for r in m.positives.collect()}
    assert weights["new"] > weights["old"] > 0


def test_soft_negative_and_seen(spark):
    m = model(spark, view("u", "101", 120, "next_button", impressions=["301", "101"]))
    assert set(pairs(m.negatives)) == {"301"}
    assert {r.content_id for r in m.seen.collect()} == {"101", "301"}


def test_dwell_from_start_and_end(spark):
    rows = [(*r[:4], None, *r[5:]) for r in view("u", "101", 42, "next_button")]
    v = sg.aggregate_views(events(spark, rows)).first()
    assert v.dwell_seconds == 42.0 and v.visits == 1 and v.end_reason == "next_button"


def test_recency_and_behavior(spark):
    m = model(spark, view("u", "101", 120, "next_button", hours=2) + view("u", "103", 120, "next_button"))
    assert sg.latest_view(m.views).first().content_id == "103"
    b = m.behavior.first()
    assert (b.n_views, b.n_positive, b.completion_rate, b.depth) == (2, 2, 1.0, 1.0)


def test_survey_seeds_model(spark):
    answers = {"q:age": ["a:age:25_34"], "gender": ["female"], "nationality": ["spain"], "province": ["Zuid-Holland"],
               "q:personalization_theme": ["forced_labour", "12"], "email": ["x@y.org"]}
    m = model(spark, [("u", "SURVEY_SUBMITTED", NOW, None, None, None, [], answers)])
    a = pairs(m.tag_affinity, key="key")
    assert a["theme_what:forced labor"] == 1.0
    for key in ("person_who.age_group:age 25-34", "person_who.gender_and_age:female", "person_who.city_village_country:from: spain",
                "person_who.city_village_country:international", "person_who.province_netherlands:zuid-holland"):
        assert key in a
    d = m.demographics.first()
    assert (d.age, d.gender, d.email_shared) == ("25_34", "female", "yes")


def test_provider_overrides_and_numeric_age(spark):
    p = spark.createDataFrame([("u", "20", "female")], "user_id string, age string, gender string")
    m = model(spark, view("u", "101", 120, "next_button"), provider=p)
    assert "person_who.age_group:age 18-24" in pairs(m.tag_affinity, key="key")
