import pytest

from recspark.operators import evaluation as ev
from recspark.operators import signals as sg
from recspark.operators.scoring import Catalogue

ROWS = [("r", "a", "target", 0.5), ("r", "b", "distractor", 0.1), ("r", "b", "target", None), ("s", "a", "target", 1.0), (None, "c", "target", 0.25), (None, "a", "target", 0.75)]


def test_vectors_are_summed_as_numbers(spark):
    """Lists with repeated items, a null id and an item without a vector; no aggregate holds its vectors as objects, which it would sort."""
    items = spark.createDataFrame(ROWS, "request_id string, content_id string, role string, relevance_score double")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("c", None)], "content_id string, vec array<double>")
    tags = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y")], "content_id string, key string")
    out = ev.list_metrics(items, Catalogue(None, tags, vectors))
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().toString()
    got = {r.request_id: (r.n_items, r.n_targets, r.distractor_present, r.intra_list_diversity) for r in out.collect()}
    assert got["r"][:3] == (3, 2, True) and got["s"] == (1, 1, False, None) and got[None][:3] == (2, 2, False)
    assert got["r"][3] == pytest.approx((0.2 + 0.2 + 0.0) / 3)


def test_centroids_keep_their_sums(spark):
    likes = spark.createDataFrame([("u", "a", 2.0), ("u", "b", 1.0), ("v", "b", 0.0), ("w", "c", 1.0)], "user_id string, content_id string, weight double")
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("c", None)], "content_id string, vec array<double>")
    out = sg.weighted_centroid(likes, vectors, ["user_id"], "weight", "taste")
    assert "ObjectHashAggregate" not in out._jdf.queryExecution().toString()
    got = {r.user_id: r.taste for r in out.collect()}
    assert list(got) == ["u"] and got["u"] == pytest.approx([6 / 136**0.5, 10 / 136**0.5])
    assert sg.weighted_centroid(likes, vectors.where("vec IS NULL"), ["user_id"], "weight", "taste").collect() == []
