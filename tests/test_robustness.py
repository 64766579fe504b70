from datetime import datetime
from types import SimpleNamespace

import pytest

from recspark import session
from recspark.functions import survey as sv
from recspark.operators import clusters as cl
from recspark.operators import signals as sg

EVENT = ("event_id long, user_id string, event string, ts timestamp, content_id string, dwell_seconds double, end_reason string, "
         "survey_answers map<string,array<string>>")


def test_an_empty_rating_and_a_long_digit_answer_stop_nothing(spark):
    at = datetime(2026, 6, 1)
    rows = [(1, "u", "CONTENT_VIEW_ENDED", at, "7", 3.0, None, {"rating": []}), (2, "u", "CONTENT_VIEW_ENDED", datetime(2026, 5, 1), "7", 3.0, None, {"rating": ["4"]}),
            (3, "u", "SURVEY_SUBMITTED", at, None, None, None, {"interest": ["99999999999"]})]
    events = spark.createDataFrame(rows, EVENT)
    assert sg.aggregate_views(events).first().survey_rating is None
    assert [(r.score, r.scale) for r in sv.split_answers(events).filter("base = 'interest'").collect()] == [(None, None)]


def test_user_ids_are_quoted(spark):
    points = spark.createDataFrame([("o'neil", "k", 1.0), ("b\\", "k", 2.0)], "user_id string, key string, weight double")
    assert cl.centroids_of_users(points, ["o'neil", "b\\"]).first().c == [1.0, 2.0]


def test_a_cluster_needs_a_shared_folder():
    def fake(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="test"))

    assert session.shared_folder(fake("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_folder(fake(master))


def test_a_run_leaves_no_tables_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    assert session.materialize(spark.range(3)).count() == 3
    assert list((tmp_path / "recspark").iterdir())
    session.clear_run(spark)
    assert not list((tmp_path / "recspark").iterdir())


def test_vectors_of_different_lengths_are_an_error(spark):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0, 3.0]), ("c", None)], "content_id string, vec array<double>")
    with pytest.raises(ValueError, match="1 of 3"):
        sg.vector_dim(vectors)
    assert sg.vector_dim(vectors.filter("content_id <> 'b'")) == 2
    likes = spark.createDataFrame([("u", "a", 2.0), ("v", "c", 1.0)], "user_id string, content_id string, weight double")
    got = sg.weighted_centroid(likes, vectors, ["user_id"], "weight", "taste").collect()
    assert [(r.user_id, [round(x, 6) for x in r.taste]) for r in got] == [("u", [round(1 / 5**0.5, 6), round(2 / 5**0.5, 6)])]
