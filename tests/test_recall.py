import math
import random

from recspark.operators import candidates as cg


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_radius_search_equals_brute_force_at_all_sizes(spark):
    rng = random.Random(1)
    items = [(f"i{n}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for n in range(150)] + [(f"s{n}", 52.75 + n * 1e-5, 9.9) for n in range(100)]
    asked = [(f"r{n}", "u", rng.uniform(-89, 89), rng.uniform(-180, 180), 10.0 ** rng.uniform(2, 7)) for n in range(40)]
    asked += [("site", "u", 52.75, 9.9, 50.0), ("pole", "u", 89.99, 0.0, 3e6), ("date", "u", 0.0, 179.99, 2e6), ("zero", "u", 52.75, 9.9, 0.0), ("all", "u", 0.0, 0.0, 3e7)]
    got = {(r.request_id, r.content_id) for r in cg.in_radius(
        spark.createDataFrame(asked, "request_id string, user_id string, lat double, lon double, radius_m double"), spark.createDataFrame(items, "content_id string, lat double, lon double")).collect()}
    assert got == {(q, i) for q, _, a, b, r in asked for i, c, d in items if metres(a, b, c, d) <= r}


def test_filter_recall_with_a_value_on_a_third_of_the_catalogue(spark):
    rng = random.Random(2)
    values = [(f"c{n:04d}", "common") for n in range(600)] + [(f"c{n:04d}", f"rare {n % 7}") for n in range(600, 900)]
    seen = [(f"u{n % 5}", f"c{rng.randrange(900):04d}") for n in range(400)]
    asked = [(f"r{n}", f"u{n % 6}", rng.choice(["common", "rare 1", "none"])) for n in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        q = spark.createDataFrame(asked, "request_id string, user_id string, filter string")
        v, s = spark.createDataFrame(values, "content_id string, value string"), spark.createDataFrame(seen, "user_id string, content_id string").distinct()
        for known in (s, None):
            got = {(r.request_id, r.content_id) for r in cg.filter_recall(q, v, known, 5).collect()}
            want = set()
            for r, u, f in asked:
                left = sorted(c for c, x in values if x == f and (known is None or (u, c) not in set(seen)))
                want |= {(r, c) for c in left[:5]}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
