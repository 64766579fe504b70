from datetime import datetime, timedelta

import pytest

from recspark.config import RecConfig
from recspark.operators import replay as rp
from recspark.operators.scoring import Catalogue


def catalogue(spark):
    contents = spark.createDataFrame([(c, 42, False) for c in "abc"], "content_id string, word_count int, has_image boolean")
    tags = spark.createDataFrame([("a", 0, "theme_what", "x", 1.0, "theme_what:x"), ("b", 0, "theme_what", "y", 1.0, "theme_what:y"), ("c", 0, "theme_what", "x", 1.0, "theme_what:x"),
                                  ("c", 1, "theme_what", "z", 1.0, "theme_what:z"), ("a", 1, "theme_what", "w", 0.5, "theme_what:w")],
                                 "content_id string, pos int, facet string, label string, weight double, key string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.5])], "content_id string, vec array<double>")
    return Catalogue(contents, tags, vectors)


def views(spark, days):
    """Like a on day 0 and b on day d, drop b on d + 3, look at c, which is like a, on d + 4."""
    start = datetime(2020, 1, 1)
    rows = [(0, "a", "next_button", 60.0), (days, "b", "next_button", 5.0), (days + 3, "b", "abandon", 0.0), (days + 4, "c", "next_button", 30.0)]
    return spark.createDataFrame([("u", n, c, start + timedelta(days=d), s, r, 1) for n, (d, c, r, s) in enumerate(rows)],
                                 "user_id string, event_id long, content_id string, ts timestamp, dwell_seconds double, end_reason string, visits int")


def test_old_likes_count_alike_however_long_ago(spark):
    cat = catalogue(spark)
    for days in (20, 400, 800):
        last = next(r for r in rp.replay_samples(views(spark, days), cat, RecConfig()).collect() if r.event_id == 3)
        # only a is liked then: x has two thirds of its tag weight
        assert (last.tag, last.aversion) == (pytest.approx(2 / 3), 0.0)
        assert last.semantic == pytest.approx((1 / 1.25**0.5 + 1) / 2)


def test_too_long_a_history_is_an_error(spark):
    with pytest.raises(ValueError, match="replay it in parts"):
        rp.replay_samples(views(spark, 5000), catalogue(spark), RecConfig())
