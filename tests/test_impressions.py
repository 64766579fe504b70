import json
import time
import uuid

import pytest

from recspark.config import RecConfig
from recspark.streaming import impressions as im
from recspark.streaming import online

X = [1.0, 0.0, 0.5, 0.0, 0.0, 0.0]
SHOWN = "request_id string, content_id string, features array<double>"
ENDED = "request_id string, content_id string, event string, ts timestamp, dwell_seconds double, end_reason string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", im.STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


class Stream:
    """One query over two folders; each run is a restart from the checkpoint."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options
        for name in ("shown", "ended"):
            (path / name).mkdir(parents=True)

    def run(self, shown=(), ended=()):
        for name, rows in (("shown", shown), ("ended", ended)):
            if rows:
                (self.path / name / f"{uuid.uuid4().hex}.json").write_text("\n".join(json.dumps(r) for r in rows))
        met = im.met_impressions(self.spark.readStream.schema(SHOWN).json(str(self.path / "shown")), self.spark.readStream.schema(ENDED).json(str(self.path / "ended")), **self.options)
        q = met.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        assert q.exception() is None
        return sorted((r.request_id, r.content_id, r.dwell_seconds, r.opened) for r in self.spark.read.schema(im.MET).parquet(str(self.path / "out")).collect())


def shown(request, content, features=X):
    return {"request_id": request, "content_id": content, "features": features}


def ended(request, content, dwell, at="2026-06-10T10:00:00"):
    return {"request_id": request, "content_id": content, "event": "CONTENT_VIEW_ENDED", "ts": at, "dwell_seconds": dwell, "end_reason": "next_button"}


def test_each_impression_pays_once_over_restarts_and_wrong_clocks(rocks, tmp_path):
    s = Stream(rocks, tmp_path)
    # the earliest reward of a batch pays; clocks are years off, which neither loses nor delays anything
    got = s.run([shown("r1", "7"), shown("r1", "8"), shown("r1", "9", []), shown(None, "7")], [ended("r1", "7", 60.0, "2031-01-01T00:00:00"), ended("r1", "7", 5.0, "1999-01-01T00:00:00"), ended("r2", "7", 1.0)])
    assert got == [("r1", "7", 5.0, True)]
    # after a restart: the same reward and the same impression again, and a reward of the other item
    got = s.run([shown("r1", "7"), shown("r2", "7")], [ended("r1", "7", 60.0), ended("r1", "8", 9.0), ended("r1", "9", 1.0), ended(None, "8", 1.0)])
    assert got == [("r1", "7", 5.0, True), ("r1", "8", 9.0, True)]
    # a reward that came before its impression is gone, the next one pays
    assert s.run([], [ended("r2", "7", 2.0), ended("r2", "7", 3.0)]) == [("r1", "7", 5.0, True), ("r1", "8", 9.0, True), ("r2", "7", 2.0, True)]


def test_requests_expire_and_unopened_items_come_out_once(rocks, tmp_path):
    s = Stream(rocks, tmp_path, ttl_ms=1500, unopened=True)
    assert s.run([shown("r1", "7"), shown("r1", "8")], [ended("r1", "7", 4.0)]) == [("r1", "7", 4.0, True)]
    time.sleep(2)
    late = s.run([shown("r9", "1")], [ended("r9", "2", 1.0)])
    assert late == [("r1", "7", 4.0, True), ("r1", "8", None, False)]
    assert s.run([], [ended("r1", "8", 6.0)])[:2] == late and all(r[0] != "r1" or r in late for r in s.run([], [ended("r1", "8", 6.0)]))


def test_rewards_train_the_policy(rocks, tmp_path):
    s = Stream(rocks, tmp_path)
    s.run([shown("r1", "7"), shown("r2", "x")], [ended("r1", "7", 60.0), ended("r2", "x", 1.0)])
    contents = rocks.createDataFrame([("7", 120, False)], "content_id string, word_count int, has_image boolean")
    met = rocks.readStream.schema(im.MET).parquet(str(tmp_path / "out"))
    q = online.start_online(im.state_rewards(met, contents, RecConfig()), str(tmp_path / "inc"), str(tmp_path / "cp2"), trigger={"availableNow": True})
    q.awaitTermination(60)
    p = online.current_policy(rocks, str(tmp_path / "inc"), RecConfig()).first()
    assert p.n_updates == 2 and p.a[0] == pytest.approx(3.0)
