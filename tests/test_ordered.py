import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recspark.functions import ordered as od

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for n in range(400):
        user = "hot" if n % 3 else rng.choice("abc")
        out.append((n, user, T0 + timedelta(minutes=rng.randrange(0, 6000)), rng.choice([None, 1.0, 2.0, 5.0])))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id int, user_id string, ts timestamp, x double")


def by_user(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    return {u: sorted(g, key=lambda r: (r[2], r[0])) for u, g in groups.items()}


def test_neighbours_match_plain_order(frame, rows):
    lag = {r.event_id: r.p for r in od.neighbour(frame, ["user_id"], "ts", "event_id", F.col("event_id"), "p", block_seconds=3600).collect()}
    lead = {r.event_id: r.p for r in od.neighbour(frame, ["user_id"], "ts", "event_id", F.col("event_id"), "p", forward=True, block_seconds=3600).collect()}
    for g in by_user(rows).values():
        for a, b in zip([None, *g], [*g, None]):
            if b is not None:
                assert lag[b[0]] == (a[0] if a else None)
            if a is not None:
                assert lead[a[0]] == (b[0] if b else None)


def test_last_before_and_running_sum(frame, rows):
    last = {r.event_id: r.p for r in od.last_before(frame, ["user_id"], "ts", "event_id", F.col("x"), "p", inclusive=False, block_seconds=3600).collect()}
    total = {r.event_id: r.p for r in od.running_sum(frame, ["user_id"], "ts", "event_id", F.expr("coalesce(x, 0D)"), "p", block_seconds=3600).collect()}
    for g in by_user(rows).values():
        seen, acc = None, 0.0
        for r in g:
            assert last[r[0]] == seen and total[r[0]] == pytest.approx(acc)
            seen, acc = (r[3] if r[3] is not None else seen), acc + (r[3] or 0.0)


def test_order_statistic_and_positions(spark):
    values = [random.Random(n).randrange(0, 10**10) for n in range(101)] + [7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert od.kth_smallest(df, "v", F.expr("floor(n / 2)"), "m").first().m == sorted(values)[len(values) // 2]
    assert od.kth_smallest(df.filter("v < 0"), "v", F.expr("floor(n / 2)"), "m").count() == 0
    ids = spark.range(300).selectExpr("CAST(id AS STRING) AS id")
    placed = od.global_position(ids, F.expr("md5(id)"), "id").orderBy("position").collect()
    assert [r.position for r in placed] == list(range(1, 301))


def test_interval_join_counts_inclusive_ends(spark):
    points = spark.createDataFrame([("u", T0 + timedelta(hours=h)) for h in (0, 5, 30, 31, 60)], "user_id string, ts timestamp")
    spans = spark.createDataFrame([("u", T0, T0 + timedelta(hours=30)), ("u", T0 + timedelta(hours=30), T0 + timedelta(hours=59))],
                                  "user_id string, start timestamp, end timestamp")
    got = od.interval_join(points, spans, ["user_id"], "ts", "start", "end").groupBy("start").count().collect()
    assert sorted(r["count"] for r in got) == [2, 3]
    assert od.interval_join(points, spans, ["user_id"], "ts", "start", "end", how="left_anti").count() == 1


def test_blocks_of_places_match_plain_order(spark, rows):
    """Blocks by the number of rows instead of time: the same prefix sums and neighbours."""
    groups = by_user(rows)
    placed = [(*r, n // 7) for g in groups.values() for n, r in enumerate(g)]
    frame = spark.createDataFrame(placed, "event_id int, user_id string, ts timestamp, x double, span long").repartition(3)
    sums = {r.event_id: r.s for r in od.running(frame, ["user_id"], "ts", "event_id", {"s": "sum(event_id)"}, block="span").collect()}
    lag = {r.event_id: r.p for r in od.neighbour(frame, ["user_id"], "ts", "event_id", F.col("event_id"), "p", block="span").collect()}
    for g in groups.values():
        for n, r in enumerate(g):
            assert sums[r[0]] == (sum(x[0] for x in g[:n]) if n else None)
            assert lag[r[0]] == (g[n - 1][0] if n else None)
