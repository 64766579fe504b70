"""Live ingest: normalise, log and refresh the visitors a micro-batch touches."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recspark.sources.logs import append_events, distinct_events, read_events, within_window
from recspark.sources.payloads import normalize_payloads

LATENESS = "1 day"


def start_ingest(bronze: DataFrame, log_dir: str, checkpoint: str, refresh: Callable[[DataFrame, int], None] | None = None,
                 tenant: str = "default", window_days: int = 30, trigger: dict | None = None,
                 now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> StreamingQuery:
    """Append each batch to the log, then hand the full recent history of its visitors on.

    Every event is logged, however late, and no clock of a device decides about it: the log is written per batch, so a
    retried batch replaces itself, and repeated deliveries are dropped by their key when the log is read. ``refresh`` gets
    the logged events of the visitors in the batch inside the retention window before ``now``, the time of processing:
    the model is refolded from the log, so late and unordered events are correct.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        append_events(batch, log_dir, tenant, f"stream-{batch_id}")
        touched = batch.select("user_id").distinct()
        if refresh is not None and touched.limit(1).count():
            at = now()
            micros = int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1_000_000)
            log = read_events(batch.sparkSession, log_dir, distinct=False).filter(F.col("tenant") == tenant)
            recent = within_window(log, f"timestamp_micros({micros})", window_days)
            refresh(distinct_events(recent.join(touched, "user_id", "left_semi")), batch_id)
        batch.unpersist()

    return normalize_payloads(bronze).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": "1 minute"})
    ).start()


def daily_counts(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Tumbling days: events and (approximate) distinct visitors."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day")).agg(
        F.expr("count(*) AS events"), F.expr("approx_count_distinct(user_id) AS visitors")
    ).selectExpr("CAST(window.start AS DATE) AS date", "events", "visitors")


def live_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Gap sessions per visitor."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(
        F.expr("count(*) AS n_events")
    ).selectExpr("user_id", "session_window.start AS start", "session_window.end AS end", "n_events")


def fresh_models(models: DataFrame, now: str, ttl_days: int = 7) -> DataFrame:
    """Models refreshed within their time to live."""
    return models.filter(f"refreshed_at > {now} - INTERVAL {int(ttl_days)} DAYS")
