import json
from datetime import datetime

import pytest

from recspark.config import RecConfig
from recspark.sources import logs
from recspark.streaming import ingest, online


def write(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"part-{len(list(path.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))


def finish(q):
    q.awaitTermination(60)
    q.stop()


def payload(user, content, ts, reason="next_button"):
    return json.dumps({"event": "CONTENT_VIEW_ENDED", "userId": user, "timestamp": ts,
                       "properties": {"content": content, "details": {"reason": reason, "dwell_seconds": 30}}})


def test_ingest_logs_once_and_refreshes_touched_visitors(spark, tmp_path):
    src = tmp_path / "in"
    ingest_ts = "2026-06-10T13:00:00"
    one, two = payload("u1", "content_7", "2026-06-10T10:00:00Z"), payload("u2", "8", "2026-06-10T09:00:00Z")
    write(src, [{"value": v, "ingest_ts": ingest_ts} for v in (one, one, two, '{"event": "X"}', "not json")])
    seen = []

    def refresh(history, batch_id):
        seen.append(sorted((r.user_id, r.content_id) for r in history.collect()))

    def run():
        bronze = spark.readStream.schema("value string, ingest_ts timestamp").json(str(src))
        finish(ingest.start_ingest(bronze, str(tmp_path / "log"), str(tmp_path / "cp"), refresh, trigger={"availableNow": True},
                                   now=lambda: datetime(2026, 6, 10, 14)))

    run()
    write(src, [{"value": payload("u1", "9", "2026-06-10T08:00:00Z"), "ingest_ts": ingest_ts}])
    run()
    assert [s for s in seen if s] == [[("u1", "7"), ("u2", "8")], [("u1", "7"), ("u1", "9")]]
    log = logs.read_events(spark, str(tmp_path / "log"))
    assert log.count() == 3 and {str(r.date) for r in log.select("date").distinct().collect()} == {"2026-06-10"}
    counts = logs.compact(spark, str(tmp_path / "log"), str(tmp_path / "big"))
    assert counts.first().n == 3


def test_late_and_future_events_and_repeated_batches(spark, tmp_path):
    """Nothing is lost to a wrong clock, and a batch that is written twice counts once."""
    src, log, seen = tmp_path / "in", str(tmp_path / "log"), []
    at = "2026-06-10T13:00:00"

    def run(rows):
        write(src, [{"value": v, "ingest_ts": at} for v in rows])
        bronze = spark.readStream.schema("value string, ingest_ts timestamp").json(str(src))
        finish(ingest.start_ingest(bronze, log, str(tmp_path / "cp"), lambda h, _: seen.append(sorted((r.user_id, r.content_id) for r in h.collect())),
                                   trigger={"availableNow": True}, now=lambda: datetime(2026, 6, 10, 14)))

    run([payload("u1", "1", "2030-01-01T00:00:00Z"), payload("u1", "2", "2026-06-09T00:00:00Z")])
    run([payload("u2", "3", "2026-06-10T10:00:00Z"), payload("u1", "4", "2026-06-08T10:00:00Z"), payload("u1", "5", "2026-01-01T00:00:00Z")])
    assert [s for s in seen if s] == [[("u1", "1"), ("u1", "2")], [("u1", "1"), ("u1", "2"), ("u1", "4"), ("u2", "3")]]
    assert logs.read_events(spark, log).count() == 5
    again = logs.read_events(spark, log, distinct=False).filter("content_id = '3'").drop("batch", "date", "tenant", "event_key")
    rows = spark.createDataFrame(again.collect(), again.schema)
    for _ in range(2):
        logs.append_events(rows, log, batch="by-hand")
    assert logs.read_events(spark, log, distinct=False).count() == 6
    assert logs.read_events(spark, log).count() == 5


def test_rewards_meet_impressions_once(spark, tmp_path):
    cfg = RecConfig()
    shown, ended = tmp_path / "shown", tmp_path / "ended"
    x = [1.0, 0.0, 0.5, 0.0, 0.0, 0.0]
    write(shown, [{"request_id": r, "content_id": "7", "served_ts": "2026-06-10T10:00:00", "features": x} for r in ("r1", "r2")])
    good = {"request_id": "r1", "content_id": "7", "event": "CONTENT_VIEW_ENDED", "ts": "2026-06-10T10:05:00", "dwell_seconds": 60.0, "end_reason": "next_button"}
    write(ended, [good, {**good, "ts": "2026-06-10T10:06:00"}, {**good, "request_id": "r2", "ts": "2026-06-12T10:06:00"}])
    contents = spark.createDataFrame([("7", 120, False)], "content_id string, word_count int, has_image boolean")
    imp = spark.readStream.schema("request_id string, content_id string, served_ts timestamp, features array<double>").json(str(shown))
    ev = spark.readStream.schema("request_id string, content_id string, event string, ts timestamp, dwell_seconds double, end_reason string").json(str(ended))
    rewards = online.online_rewards(imp, ev, contents, cfg)
    finish(online.start_online(rewards, str(tmp_path / "inc"), str(tmp_path / "cp"), trigger={"availableNow": True}))
    p = online.current_policy(spark, str(tmp_path / "inc"), cfg).first()
    assert p.n_updates == 1 and p.a[0] == pytest.approx(2.0) and p.theta[0] > 0.2
    last = online.fold_increments(spark, str(tmp_path / "inc"), str(tmp_path / "fold"))
    again = online.current_policy(spark, str(tmp_path / "inc"), cfg, str(tmp_path / "fold")).first()
    assert (again.n_updates, again.theta) == (1, p.theta)
    spark.createDataFrame([([0.0] * 36, [0.0] * 6, 5)], online.SUMS).write.parquet(str(tmp_path / f"inc/batch={last + 7}"))
    assert online.current_policy(spark, str(tmp_path / "inc"), cfg, str(tmp_path / "fold")).first().n_updates == 6
    assert online.fold_increments(spark, str(tmp_path / "inc"), str(tmp_path / "fold"), str(tmp_path / "fold")) == last + 7
    assert online.current_policy(spark, str(tmp_path / "inc"), cfg, str(tmp_path / "fold")).first().n_updates == 6


def test_live_windows_run_on_batches_too(spark):
    rows = [("u", datetime(2026, 6, 10, 10, m)) for m in (0, 20, 59)]
    df = spark.createDataFrame(rows, "user_id string, ts timestamp")
    assert sorted(r.n_events for r in ingest.live_sessions(df).collect()) == [1, 2]
    assert ingest.daily_counts(df).first().events == 3
