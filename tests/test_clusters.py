import itertools
import random

import pytest

from recspark.operators import clusters as cl


def frames(spark, hard, soft):
    h = spark.createDataFrame([(f"u{i}", c) for i, c in enumerate(hard)], "user_id string, cluster int")
    s = spark.createDataFrame([(f"u{i}", u, u.index(max(u))) for i, u in enumerate(soft)], "user_id string, u array<double>, dominant int")
    return h, s


def adjusted_rand(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    in_a, in_b = (sum(x[i] == x[j] for i, j in pairs) for x in (a, b))
    chance = in_a * in_b / len(pairs) if pairs else 0
    most = (in_a + in_b) / 2
    return (both - chance) / (most - chance) if most != chance else 1.0


@pytest.mark.parametrize("seed", range(3))
def test_agreement_equals_counting_pairs(spark, seed):
    rng = random.Random(seed)
    hard = [rng.randrange(4) for _ in range(40)]
    soft = []
    for c in hard:
        u = [rng.random() + (2 if j == c % 3 and rng.random() < 0.8 else 0) for j in range(3)]
        soft.append([x / sum(u) for x in u])
    table = cl.contingency(*frames(spark, hard, soft))
    one = cl.agreement(table).first()
    dominant = [u.index(max(u)) for u in soft]
    assert one.visitors == 40 and one.adjusted_rand == pytest.approx(adjusted_rand(hard, dominant))
    assert one.purity == pytest.approx(sum(max(sum(h == c and d == j for h, d in zip(hard, dominant)) for j in range(3)) for c in set(hard)) / 40)
    assert sum(r.mass for r in table.collect()) == pytest.approx(40)


def test_equal_and_trivial_groupings(spark):
    sharp = [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]
    same = cl.agreement(cl.contingency(*frames(spark, [5, 7, 5], sharp))).first()
    assert (same.adjusted_rand, same.purity, same.soft_overlap) == (1.0, 1.0, 1.0)
    one = cl.agreement(cl.contingency(*frames(spark, [0], [[1.0, 0.0]]))).first()
    assert (one.visitors, one.adjusted_rand) == (1, 1.0)


def test_a_blended_visitor_is_split(spark):
    rows = {r.user_id: r for r in cl.compare(*frames(spark, [0, 1, 0], [[0.9, 0.1], [0.2, 0.8], [0.55, 0.45]])).collect()}
    assert [rows[u].split for u in ("u0", "u1", "u2")] == [False, False, True] and rows["u1"].dominant == 1


def test_shared_tags_and_rare_features(spark):
    points = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 0.4), ("a", "z", 0.9), ("b", "x", 0.5), ("b", "y", 0.4), ("c", "x", 0.2)], "user_id string, key string, weight double")
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "user_id string, cluster int")
    centroids = spark.createDataFrame([("x", [0.3, 0.0]), ("y", [0.8, 0.9])], "key string, c array<double>")
    got = [(r.user_id, r["rank"], r.key) for r in cl.shared_tags(points, labels, centroids).orderBy("user_id", "rank").collect()]
    assert got == [("a", 1, "y"), ("a", 2, "x"), ("b", 1, "y")]
    assert {r.key for r in cl.feature_points(points, min_freq=2).collect()} == {"x", "y"}
    assert {r.key for r in cl.feature_points(points, min_freq=2, max_features=1).collect()} == {"x"}
