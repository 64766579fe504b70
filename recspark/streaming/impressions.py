"""Served impressions as keyed state: each waits for one reward, for a day.

The state hangs on the time of processing, so no device's clock decides which rewards count, and a reward needs no
watermark to pass before it pays.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from recspark.config import RecConfig
from recspark.functions import engagement as eng

TTL_MS = 24 * 3600 * 1000
# The state itself lives so much longer than its timer, which may run late.
BACKSTOP_MS = 24 * 3600 * 1000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MET = "request_id string, content_id string, features array<double>, dwell_seconds double, end_reason string, opened boolean"


class ImpressionState(StatefulProcessor):
    """Map state of one request: item -> (features, whether its reward was paid).

    A paid item stays in the map until the request expires, so that neither a reward nor an impression that is delivered again
    pays twice. A timer ends the request; the time to live behind it clears what a stopped stream left.
    """

    def __init__(self, ttl_ms: int, unopened: bool):
        self.ttl_ms, self.unopened = ttl_ms, unopened

    def init(self, handle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "content_id string", "features array<double>, paid boolean", self.ttl_ms + BACKSTOP_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        shown, first = {}, {}
        for row in rows:  # both hold at most one entry for an item, however often it came
            if row.features is not None:
                shown.setdefault(row.content_id, row.features)
            elif row.content_id not in first or (row.ts, row.dwell_seconds or 0.0, row.end_reason or "") < first[row.content_id][0]:
                first[row.content_id] = (row.ts, row.dwell_seconds or 0.0, row.end_reason or ""), row
        if shown and not self.items.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
        for content, features in shown.items():
            if not self.items.containsKey((content,)):
                self.items.updateValue((content,), (features, False))
        for content, (_, row) in first.items():
            if not self.items.containsKey((content,)):
                continue
            features, paid = self.items.getValue((content,))
            if not paid:
                self.items.updateValue((content,), (features, True))
                yield Row(request_id=key[0], content_id=content, features=list(features), dwell_seconds=row.dwell_seconds, end_reason=row.end_reason, opened=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.unopened:
            for (content,), (features, paid) in self.items.iterator():
                if not paid:
                    yield Row(request_id=key[0], content_id=content, features=list(features), dwell_seconds=None, end_reason=None, opened=False)
        self.items.clear()

    def close(self) -> None:
        pass


def met_impressions(impressions: DataFrame, events: DataFrame, ttl_ms: int = TTL_MS, unopened: bool = False) -> DataFrame:
    """(request_id, content_id, features, dwell_seconds, end_reason, opened): each impression with its first reward.

    impressions: request_id, content_id, features; events: canonical events. Both may be streams (the union is). An impression
    without features, and an event without request or item, are left out. Of several rewards in one batch the
    earliest pays. A reward that comes before its impression's batch, or later than `ttl_ms` after it, pays
    nothing. With `unopened` each impression that got none comes out once when its request expires, with `opened` false.
    The tables of a request are its own state, keyed by a hash of its id over all tasks; the session needs
    STATE_STORE as its state store provider. Timers run with every trigger; a stream that ends when its input does
    (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off, else it goes on to wait for them.
    """
    shown = impressions.filter("request_id IS NOT NULL AND content_id IS NOT NULL AND size(features) > 0").selectExpr(
        "request_id", "content_id", "features", "CAST(NULL AS TIMESTAMP) AS ts", "CAST(NULL AS DOUBLE) AS dwell_seconds", "CAST(NULL AS STRING) AS end_reason")
    ended = events.filter("event = 'CONTENT_VIEW_ENDED' AND request_id IS NOT NULL AND content_id IS NOT NULL").selectExpr(
        "request_id", "content_id", "CAST(NULL AS ARRAY<DOUBLE>) AS features", "coalesce(ts, TIMESTAMP'1970-01-01') AS ts", "dwell_seconds", "end_reason")
    return shown.unionByName(ended).groupBy("request_id").transformWithState(ImpressionState(ttl_ms, unopened), MET, "Append", "ProcessingTime")


def state_rewards(met: DataFrame, contents: DataFrame, cfg: RecConfig) -> DataFrame:
    """(request_id, content_id, features, reward): the engagement of an opened impression, 0 of one that was not."""
    known = met.join(contents.select("content_id", "word_count", "has_image"), "content_id", "left")
    estimate = f"IF(word_count IS NULL, 0D, {eng.reading_time('word_count', 'coalesce(has_image, false)', cfg)})"
    reward = eng.strength("dwell_seconds", "estimate", "end_reason", "1", "CAST(NULL AS DOUBLE)", cfg)
    return known.withColumn("estimate", F.expr(estimate)).selectExpr("request_id", "content_id", "features", f"IF(opened, {reward}, 0D) AS reward")
