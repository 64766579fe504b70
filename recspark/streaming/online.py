"""Online bandit: reward events meet their impressions within a day and update the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recspark.config import RecConfig
from recspark.functions import engagement as eng
from recspark.operators import bandit as bd

TTL = "24 hours"


def online_rewards(impressions: DataFrame, events: DataFrame, contents: DataFrame, cfg: RecConfig, event_time: str = "ts") -> DataFrame:
    """(request_id, content_id, features, reward): each impression pays at most one reward.

    impressions: request_id, content_id, served_ts, features; events: canonical events.
    Rewards later than a day after serving are dropped by the watermark join. ``event_time`` names the column that says
    when an event came: with a device's clock one wrong event moves the watermark past the others, so give the
    time of arrival where events have one.
    """
    ended = events.filter("event = 'CONTENT_VIEW_ENDED' AND request_id IS NOT NULL AND content_id IS NOT NULL")
    first = ended.withWatermark(event_time, TTL).dropDuplicatesWithinWatermark(["request_id", "content_id"]).selectExpr(
        "request_id AS r_request", "content_id AS r_content", f"{event_time} AS came", "dwell_seconds", "end_reason"
    )
    shown = impressions.filter("size(features) > 0").withWatermark("served_ts", TTL)
    met = shown.join(
        first, F.expr("request_id = r_request AND content_id = r_content AND came >= served_ts AND came <= served_ts + INTERVAL 24 HOURS")
    )
    known = met.join(contents.select("content_id", "word_count", "has_image"), "content_id", "left")
    estimate = f"IF(word_count IS NULL, 0D, {eng.reading_time('word_count', 'coalesce(has_image, false)', cfg)})"
    reward = eng.strength("dwell_seconds", "estimate", "end_reason", "1", "CAST(NULL AS DOUBLE)", cfg)
    return known.selectExpr("request_id", "content_id", "features", "dwell_seconds", "end_reason", f"{estimate} AS estimate").selectExpr(
        "request_id", "content_id", "features", f"{reward} AS reward"
    )


def start_online(rewards: DataFrame, increments: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write the A and b increments of each batch; a repeated batch overwrites its own part."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sums = bd.sufficient_sums(batch).filter("n_updates > 0")
        sums.write.mode("overwrite").parquet(f"{increments}/batch={batch_id}")

    return rewards.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "1 minute"})
    ).start()


SUMS = "a array<double>, b array<double>, n_updates bigint"


def _total(rows: DataFrame, *more) -> DataFrame:
    d = bd.D
    a = ", ".join(f"sum(a[{i}])" for i in range(d * d))
    b = ", ".join(f"sum(b[{i}])" for i in range(d))
    return rows.agg(F.expr(f"array({a}) AS a"), F.expr(f"array({b}) AS b"), F.expr("sum(n_updates) AS n_updates"), *more)


def _parts(spark, increments: str, folded: str | None) -> tuple[DataFrame, int]:
    """Sums that are not yet added up, those added up last, and the last batch in these."""
    parts = spark.read.schema(f"{SUMS}, batch bigint").parquet(increments)
    upto = -1
    if folded is not None:
        done = spark.read.schema(f"{SUMS}, upto bigint").parquet(folded)
        upto = done.agg(F.max("upto")).first()[0]
        upto = -1 if upto is None else upto
        parts = parts.filter(F.col("batch") > upto).unionByName(done.filter(F.col("upto") == upto).withColumnRenamed("upto", "batch"))
    return parts, upto


def fold_increments(spark, increments: str, folder: str, folded: str | None = None) -> int:
    """Add all increments up to the newest batch into one row of ``folder``; returns that batch.

    ``folded`` is the folder of an earlier fold, whose sum is gone on from. Increments up to the returned batch may be
    archived then. A fold that is repeated replaces its own part.
    """
    parts, upto = _parts(spark, increments, folded)
    last = parts.agg(F.max("batch")).first()[0]
    last = upto if last is None else last
    _total(parts).write.mode("overwrite").parquet(f"{folder}/upto={last}")
    return last


def current_policy(spark, increments: str, cfg: RecConfig, folded: str | None = None) -> DataFrame:
    """Policy of the prior plus all increments so far; with ``folded`` only those after the last fold are read."""
    parts, _ = _parts(spark, increments, folded)
    start = bd.prior_state(spark, cfg)
    rows = parts.selectExpr("a", "b", "n_updates", "CAST(NULL AS DOUBLE) AS ridge").unionByName(start.select("a", "b", "n_updates", "ridge"))
    return bd.policy(_total(rows, F.expr("max(ridge) AS ridge")))
