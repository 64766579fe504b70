import math
import random
from datetime import datetime, timedelta

import pytest

from recspark.config import RecConfig
from recspark.operators import replay as rp
from recspark.operators.held_likes import held_affinity


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def plain(rows, vectors):
    """Per view, the likes after the last view of each item before it."""
    out, histories = {}, {}
    for user, event, item, _, _, log_weight in sorted(rows, key=lambda r: (r[0], r[3])):
        held = {c: w for c, w in histories.setdefault(user, {}).items() if w is not None}
        if held and vectors.get(item):
            top = max(held.values())
            near = [2 ** (w - top) * (cosine(vectors[item], vectors[c]) + 1) / 2 for c, w in held.items() if vectors.get(c)]
            out[user, event] = max(near, default=0.0)
        histories[user][item] = log_weight
    return out


def histories(seed):
    rng = random.Random(seed)
    vectors = {f"c{i}": [rng.gauss(0, 1) for _ in range(4)] for i in range(12)} | {"zero": [0.0] * 4, "none": None}
    rows, event = [], 0
    for user, n in (("a", 1), ("b", 7), ("c", 40), ("d", 130), (None, 3)):
        items = [rng.choice([*vectors, "unknown"]) for _ in range(n)]
        for place, item in enumerate(items):
            later = [p for p in range(place + 1, n) if items[p] == item]
            liked = rng.choice([None, rng.uniform(-5, 2000), rng.uniform(-2, 2)])
            rows.append((user or "e", event, item, place, later[0] if later else None, liked))
            event += 1
    return rows, vectors


@pytest.mark.parametrize("leaf", [1, 3, 256])
def test_affinity_equals_a_refold_for_each_view(spark, leaf):
    rows, vectors = histories(leaf)
    states = spark.createDataFrame(rows, "user_id string, event_id long, content_id string, place long, next_place long, log_weight double").repartition(3)
    items = spark.createDataFrame(list(vectors.items()), "content_id string, vec array<double>")
    got = {(r.user_id, r.event_id): r.affinity for r in held_affinity(states, items, 4, leaf).collect()}
    want = plain(rows, vectors)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert held_affinity(states.limit(0), items, 4, leaf).count() == 0


def test_like_and_view_meet_once(spark):
    """A like held over n views reaches O(log n) nodes, and no view twice."""
    n = 1000
    rows = [("u", i, f"c{i}", i, None, 1.0 if i == 0 else None) for i in range(n)]
    states = spark.createDataFrame(rows, "user_id string, event_id long, content_id string, place long, next_place long, log_weight double")
    items = spark.createDataFrame([(f"c{i}", [1.0, float(i)]) for i in range(n)], "content_id string, vec array<double>")
    got = held_affinity(states, items, 2, leaf=2).collect()
    assert sorted(r.event_id for r in got) == list(range(1, n))


def test_affinity_of_a_long_ago_like_in_a_replay(spark):
    from tests.test_replay import catalogue, views

    last = next(r for r in rp.replay_samples(views(spark, 400), catalogue(spark), RecConfig()).collect() if r.event_id == 3)
    assert last.affinity == pytest.approx((1 / 1.25**0.5 + 1) / 2)  # only a is held then, at full relative weight
    assert last.features == [last.semantic, last.affinity, last.tag, last.recency, last.aversion, 0.0]


def test_weight_counts_against_nearness(spark):
    """An old like near the view loses against a fresh one far from it, as their weights say."""
    start = datetime(2024, 1, 1)
    rows = [(0, "a", 60.0, 0), (1, "b", 60.0, 28), (2, "c", 10.0, 28)]
    views = spark.createDataFrame([("u", n, c, start + timedelta(days=d, minutes=n), s, "next_button", 1) for n, c, s, d in rows],
                                  "user_id string, event_id long, content_id string, ts timestamp, dwell_seconds double, end_reason string, visits int")
    from tests.test_replay import catalogue

    got = {r.event_id: r.affinity for r in rp.replay_samples(views, catalogue(spark), RecConfig()).collect()}
    near, far = (1 / 1.25**0.5 + 1) / 2, (0.5 / 1.25**0.5 + 1) / 2
    assert got[0] == 0 and got[2] == pytest.approx(max(near * 0.25, far), abs=1e-3)
