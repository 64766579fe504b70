import random
from dataclasses import replace

import pytest

from recspark.config import RecConfig
from recspark.operators import candidates as cg


def made(seed):
    rng = random.Random(seed)
    keys = [f"t{i}" for i in range(12)]
    items = {f"{i:03d}": ({"hot"} if rng.random() < 0.4 else set()) | ({"warm"} if rng.random() < 0.3 else set()) | set(rng.sample(keys, rng.randrange(4))) for i in range(150)}
    users = {f"u{i}": {k: rng.random() for k in rng.sample([*keys, "hot", "warm", "gone"], rng.randrange(1, 7))} for i in range(40)}
    users |= {"only-hot": {"hot": 1.0}, "nothing": {"gone": 1.0}, "both": {"hot": 1.0, "warm": 0.5}}
    seen = [(u, i) for u in users for i in rng.sample(sorted(items), rng.choice([0, 0, 5, 60]))]
    return items, users, seen


def plain(items, users, n_keys, k, seen=()):
    out = []
    for user, weights in users.items():
        top = {key for key, _ in sorted(weights.items(), key=lambda x: (-round(x[1], 9), x[0]))[:n_keys]}
        rows = sorted((-len(top & tags), i) for i, tags in items.items() if top & tags and (user, i) not in seen)
        out += [(user, i, float(-s)) for s, i in rows[:k]]
    return sorted(out)


@pytest.mark.parametrize(("frequent", "with_seen"), [(1024, False), (20, False), (20, True), (3, True), (0, False)])
def test_recall_equals_plain_whatever_is_frequent(spark, frequent, with_seen):
    items, users, seen = made(frequent)
    cfg = replace(RecConfig(), pool_per_generator=7, tag_keys_per_user=4)
    affinity = spark.createDataFrame([(u, k, w, k) for u, ws in users.items() for k, w in ws.items()], "user_id string, key string, weight double, nkey string")
    tags = spark.createDataFrame([(i, t, 1.0) for i, ts in items.items() for t in ts], "content_id string, nkey string, weight double")
    known = spark.createDataFrame(seen, "user_id string, content_id string") if with_seen else None
    got = cg.tag_recall(affinity, tags, cfg, known, frequent)
    assert sorted(tuple(r) for r in got.collect()) == plain(items, users, 4, 7, set(seen) if with_seen else ())


def test_a_tag_on_a_third_of_all_items_is_not_paired(spark, monkeypatch):
    """Every set and a third of all items carry one tag: no join by it, so pairs don't grow with sets times sets."""
    rng = random.Random(1)
    items = {f"{i:04d}": ({"hot"} if i % 3 == 0 else set()) | {f"r{i // 2}"} for i in range(600)}
    users = {f"u{i}": {"hot": 0.5, f"r{rng.randrange(300)}": 1.0} for i in range(200)}
    cfg = replace(RecConfig(), pool_per_generator=5)
    affinity = spark.createDataFrame([(u, k, w, k) for u, ws in users.items() for k, w in ws.items()], "user_id string, key string, weight double, nkey string")
    tags = spark.createDataFrame([(i, t, 1.0) for i, ts in items.items() for t in ts], "content_id string, nkey string, weight double")
    pairs = []
    overlaps = cg._overlaps
    monkeypatch.setattr(cg, "_overlaps", lambda *a: pairs.append(overlaps(*a)) or pairs[-1])
    got = sorted(tuple(r) for r in cg.tag_recall(affinity, tags, cfg, None, 50).collect())
    assert got == plain(items, users, cfg.tag_keys_per_user, 5)
    assert sum(p.count() for p in pairs) < 3 * len(users)  # by the tag it would be 200 sets times 200 items
