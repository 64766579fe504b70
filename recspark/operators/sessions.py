"""Sessions and survey spans. All order-dependent steps use the block-wise helpers, so one
visitor with a large share of the events does not end up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.ordered import interval_join, kth_smallest, last_before, neighbour

GAP_SECONDS = 1800  # fixed value
SESSION_START = "SESSION_STARTED"
SESSION_ENDS = ("SESSION_ENDED", "GLOBAL_ENDED")
SURVEY_ENDS = ("SURVEY_SUBMITTED", "SURVEY_DISMISSED")


def paired_dwell(raw: DataFrame) -> DataFrame:
    """``start`` events with the next event on the same item, whatever its type.

    raw: user_id, item_id, event_id, event_type ('start'/'end'), ts.
    """
    paired = neighbour(raw, ["user_id", "item_id"], "ts", "event_id", F.col("ts"), "close_ts", forward=True)
    return paired.filter("event_type = 'start' AND close_ts IS NOT NULL").selectExpr(
        "user_id", "item_id", "ts AS start_ts", "close_ts", "(unix_micros(close_ts) - unix_micros(ts)) / 1e6D AS dwell_seconds"
    )


def gap_sessions(events: DataFrame, on_marker: bool) -> DataFrame:
    """Sessions cut at gaps over 30 minutes (and at start markers): user, start, end, counts."""
    lagged = neighbour(events, ["user_id"], "ts", "event_id", F.col("ts"), "prev_ts")
    cut = f"prev_ts IS NULL OR unix_micros(ts) - unix_micros(prev_ts) > {GAP_SECONDS}000000L"
    if on_marker:
        cut += f" OR event = '{SESSION_START}'"
    opened = last_before(lagged, ["user_id"], "ts", "event_id", F.expr(f"IF({cut}, struct(ts, event_id), NULL)"), "opened")
    return (
        opened.groupBy("user_id", "opened")
        .agg(F.expr("min(ts) AS start"), F.expr("max(ts) AS end"), F.expr("count(*) AS n_events"))
        .select("user_id", "start", "end", "n_events")
    )


def cohort_sessions(events: DataFrame) -> DataFrame:
    """Sessions of the cohort statistics: markers and gaps both cut, zero lengths drop out."""
    return gap_sessions(events, on_marker=True).selectExpr(
        "user_id", "start", "end", "(unix_micros(end) - unix_micros(start)) / 1e6D AS seconds"
    ).filter("seconds > 0")


def median_session(sessions: DataFrame) -> DataFrame:
    """Upper median of the session lengths as a one-row frame (none without sessions)."""
    lengths = sessions.selectExpr("unix_micros(end) - unix_micros(start) AS us")
    return kth_smallest(lengths, "us", F.expr("floor(n / 2)"), "us").selectExpr("us / 1e6D AS median_seconds")


def marker_sessions(events: DataFrame) -> DataFrame:
    """Start marker to the next marker of any kind; an open tail ends at the last event."""
    kinds = "', '".join((SESSION_START, *SESSION_ENDS))
    markers = events.filter(f"event IN ('{kinds}')").select("user_id", "event_id", "ts", "event")
    closed = neighbour(markers, ["user_id"], "ts", "event_id", F.col("ts"), "next_ts", forward=True)
    last = events.groupBy("user_id").agg(F.expr("max(ts) AS last_ts"))
    return closed.filter(f"event = '{SESSION_START}'").join(last, "user_id").selectExpr(
        "user_id", "ts AS start", "coalesce(next_ts, last_ts) AS end"
    )


def history_sessions(events: DataFrame) -> DataFrame:
    """Marker sessions; visitors without any fall back to gap sessions."""
    marked = marker_sessions(events)
    unmarked = events.join(marked.select("user_id").distinct(), "user_id", "left_anti")
    return marked.unionByName(gap_sessions(unmarked, on_marker=False).select("user_id", "start", "end"))


def survey_spans(events: DataFrame) -> DataFrame:
    """Survey presented to its submission or dismissal; of several presented the latest counts."""
    kinds = "', '".join(("SURVEY_PRESENTED", *SURVEY_ENDS))
    markers = events.filter(f"event IN ('{kinds}')").select("user_id", "event_id", "ts", "event")
    lagged = neighbour(markers, ["user_id"], "ts", "event_id", F.struct("ts", "event"), "prev")
    return lagged.filter("event <> 'SURVEY_PRESENTED' AND prev.event = 'SURVEY_PRESENTED'").selectExpr(
        "user_id", "prev.ts AS start", "ts AS end", "event AS ended"
    )


def journey(events: DataFrame) -> DataFrame:
    """Session rows with counts of the events and surveys inside, plus surveys outside any."""
    sessions = history_sessions(events)
    surveys = survey_spans(events)
    inside = interval_join(events.select("user_id", "ts", "event"), sessions, ["user_id"], "ts", "start", "end")
    counts = inside.groupBy("user_id", "start", "end").agg(
        F.expr("count(*) AS n_events"), F.expr("count_if(event = 'CONTENT_VIEW_STARTED') AS n_views")
    )
    points = surveys.selectExpr("user_id", "start AS presented", "end AS finished", "ended")
    held = interval_join(points, sessions, ["user_id"], "presented", "start", "end")
    nested = held.groupBy("user_id", "start", "end").agg(F.expr("count(*) AS n_surveys"))
    rows = sessions.join(counts, ["user_id", "start", "end"], "left").join(nested, ["user_id", "start", "end"], "left")
    blocks = rows.selectExpr(
        "'session' AS kind", "user_id", "start", "end", "coalesce(n_events, 0) AS n_events",
        "coalesce(n_views, 0) AS n_views", "coalesce(n_surveys, 0) AS n_surveys", "CAST(NULL AS STRING) AS ended",
    )
    loose = interval_join(points, sessions, ["user_id"], "presented", "start", "end", how="left_anti")
    return blocks.unionByName(loose.selectExpr(
        "'survey' AS kind", "user_id", "presented AS start", "finished AS end", "0L AS n_events", "0L AS n_views",
        "0L AS n_surveys", "ended",
    ))
