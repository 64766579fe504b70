from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recspark.sources import catalogue as ct
from recspark.sources import logs


def served(spark, rows):
    item = "array(struct('7' AS id, 1 AS rank, 'target' AS role, 0.5D AS relevance_score, map('tag', 0.1D) AS breakdown, array(1D) AS features))"
    return spark.createDataFrame(rows, "request_id string, user_id string, ts timestamp").selectExpr(
        "request_id", "user_id", "ts", "'warm' AS strategy", "CAST(NULL AS STRING) AS filter", "false AS cold_start", "'static' AS ranking", "CAST(NULL AS STRING) AS distractor_id", f"{item} AS items")


def read_days(df):
    """Days that a plan's scan reads."""
    return {f.split("date=")[1].split("/")[0] for f in df.inputFiles() if "date=" in f}


def test_newest_rows_read_the_newest_days_only(spark, tmp_path, monkeypatch):
    start, base = datetime(2026, 6, 1, 12), str(tmp_path)
    rows = [(f"r{d}-{i}", "u1" if d % 4 == 0 else "u2", start + timedelta(days=d, minutes=i)) for d in range(20) for i in range(3)]
    logs.append_served(served(spark, rows), base, "camp", batch="one")
    logs.append_served(served(spark, [("other", "u1", start + timedelta(days=40))]), base, "town", batch="one")
    seen = []
    tail = logs.served_tail
    monkeypatch.setattr(logs, "served_tail", lambda df, n, user=None: seen.append(read_days(df.filter("true"))) or tail(df, n, user))
    newest = sorted(rows, key=lambda r: (r[2], r[0]), reverse=True)
    got = [r.request_id for r in logs.newest_served(spark, base, 4, "camp").collect()]
    assert got == [r[0] for r in newest[:4]]
    plan = logs.newest_served(spark, base, 4, "camp")._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "2026-06-19" in plan
    mine = [r.request_id for r in logs.newest_served(spark, base, 5, "camp", "u1").collect()]
    assert mine == [r[0] for r in newest if r[1] == "u1"][:5]
    assert logs.newest_served(spark, base, 1000, "camp").count() == 60
    assert logs.newest_served(spark, base, 3, "nobody").count() == 0
    items = logs.newest_served(spark, base, 1).first()["items"]
    assert [i.asDict() for i in items] == [{"id": "7", "rank": 1, "role": "target"}]


def test_the_hot_history_reads_its_days_only(spark, tmp_path):
    rows = [("u", f"e{d}", datetime(2026, 6, 1) + timedelta(days=d)) for d in range(30)]
    events = spark.createDataFrame(rows, "user_id string, event string, ts timestamp").selectExpr(
        "*", "CAST(array() AS ARRAY<STRING>) AS impressions", "CAST(map() AS MAP<STRING, ARRAY<STRING>>) AS survey_answers")
    logs.append_events(events, str(tmp_path))
    recent = logs.within_window(logs.read_events(spark, str(tmp_path), distinct=False), "TIMESTAMP'2026-06-30 12:00:00'", 3)
    assert sorted(r.event for r in recent.collect()) == ["e27", "e28", "e29"]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "date#" in plan.split("PartitionFilters: ")[1].split("]")[0]


def test_a_busy_day_is_several_lines(spark, tmp_path):
    start = datetime(2026, 6, 1)
    rows = [("busy", f"{i % 9}", float(i), "link", start + timedelta(seconds=i)) for i in range(500)] + [("calm", "1", 2.0, None, start)]
    views = spark.createDataFrame(rows, "user_id string, content_id string, dwell_seconds double, end_reason string, ts timestamp")
    ct.write_session_views(views, str(tmp_path / "lines"), line_views=50)
    lines = spark.read.schema(ct.SESSION_LINE).json(str(tmp_path / "lines")).selectExpr("user_id", "size(views) AS n").collect()
    assert max(line.n for line in lines) < 150 and sum(line.user_id == "busy" for line in lines) >= 5
    back = ct.read_session_views(spark, str(tmp_path / "lines"))
    assert sorted((r.user_id, r.content_id, r.dwell_seconds, r.end_reason or "", r.ts) for r in back.collect()) == sorted((u, c, d, e or "", t) for u, c, d, e, t in rows)


def test_repeated_deliveries_go_and_only_they_are_shuffled(spark, tmp_path):
    rows = [(f"u{i % 5}", f"e{i}", datetime(2026, 6, 1) + timedelta(hours=i), f"raw {i}") for i in range(60)]
    events = spark.createDataFrame(rows, "user_id string, event string, ts timestamp, raw string").selectExpr(
        "*", "CAST(array() AS ARRAY<STRING>) AS impressions", "CAST(map() AS MAP<STRING, ARRAY<STRING>>) AS survey_answers")
    logs.append_events(events, str(tmp_path), batch="one")
    logs.append_events(events.filter("raw IN ('raw 3', 'raw 4')"), str(tmp_path), batch="two")
    logs.append_events(events.filter("raw = 'raw 3'"), str(tmp_path), "town", batch="two")
    log = logs.read_events(spark, str(tmp_path))
    assert log.count() == 61 and log.filter("raw = 'raw 3'").count() == 2
    # old rows have no key and all stay
    old = log.withColumn("event_key", F.expr("IF(raw = 'raw 9', NULL, event_key)")).unionByName(log.filter("raw = 'raw 9'").withColumn("event_key", F.lit(None).cast("string")))
    assert logs.distinct_events(old).filter("raw = 'raw 9'").count() == 2
    log.collect()
    plan = log._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert wide and any("_mark" in line for line in wide)
