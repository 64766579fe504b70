"""Cohort, content and served-log statistics over all visitors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions import survey as sv
from recspark.functions.ordered import top_k
from recspark.operators.sessions import cohort_sessions, median_session

THEME_ROOTS = ("theme_what", "theme_how", "place_where", "location")  # fixed values


def parse_ranges(text: str | None) -> dict[str, tuple[int, int]]:
    """``boring:4-5,interest:1-2`` to ranges; parts that do not parse are left out."""
    out = {}
    for part in (text or "").split(","):
        name, _, span = part.partition(":")
        low, _, high = span.partition("-")
        if low.strip().isdigit() and high.strip().isdigit():
            out[name.strip()] = (int(low), int(high))
    return out


def _failed(filters: dict[str, set[str]]) -> dict[str, str]:
    return {f: f"NOT coalesce({f}, '') IN ({sv.sql_list(sorted(v))})" for f, v in filters.items()}


def canonical_wide(demo: DataFrame) -> DataFrame:
    """Canonical demographics in one row per visitor; a missing gender is ``no_answer``."""
    fields = [f"{sv.canon_demo_value(sv.sql_text(f), f)} AS {f}" for f in sv.DEMO_FIELDS]
    present = [f"{f} IS NOT NULL AS has_{f}" for f in sv.DEMO_FIELDS]
    return demo.selectExpr("user_id", *fields, *present)


def range_failures(scores: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """(user_id, passed): questions of the ranges each visitor answered inside them."""
    inside = " OR ".join(f"(question = {sv.sql_text(q)} AND score BETWEEN {lo} AND {hi})" for q, (lo, hi) in ranges.items())
    return scores.filter(inside or "false").groupBy("user_id").agg(F.expr("count(*) AS passed"))


def matched(users: DataFrame, demo: DataFrame, scores: DataFrame, filters: dict[str, set[str]],
            ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Every visitor with the number of failed demographic filters and of failed score ranges."""
    fails = _failed(filters)
    count = " + ".join(f"IF({t}, 1, 0)" for t in fails.values()) or "0"
    own = [f"{t} AS fails_{f}" for f, t in fails.items()]
    empty_gender = "IF(gender IS NULL, 'no_answer', gender) AS gender"
    base = users.select("user_id").join(canonical_wide(demo), "user_id", "left")
    base = base.selectExpr("user_id", *[empty_gender if f == "gender" else f for f in sv.DEMO_FIELDS],
                           *[f"coalesce(has_{f}, false) AS has_{f}" for f in sv.DEMO_FIELDS])
    out = base.selectExpr("*", f"{count} AS fails", *own)
    if not ranges:
        return out.withColumn("range_fails", F.lit(0))
    return out.join(range_failures(scores, ranges), "user_id", "left").selectExpr(
        "*", f"{len(ranges)} - coalesce(passed, 0) AS range_fails"
    ).drop("passed")


def faceted_counts(match: DataFrame, filters: dict[str, set[str]]) -> DataFrame:
    """(field, value, visitors): each field counted against the filters of the other fields.

    One pass: a visitor counts for a field when nothing fails, or only that field does.
    """
    rows = ", ".join(
        f"struct('{f}' AS field, {f} AS value, has_{f} AS has, {f'fails_{f}' if f in filters else 'false'} AS own)" for f in sv.DEMO_FIELDS
    )
    long = match.filter("range_fails = 0 AND fails <= 1").selectExpr("fails", f"inline(array({rows}))")
    return long.filter("has AND value IS NOT NULL AND (fails = 0 OR own)").groupBy("field", "value").agg(
        F.expr("count(*) AS visitors")
    )


def cohort_behavior(match: DataFrame, model, served: DataFrame, filtered: bool) -> DataFrame:
    """One row of volumes, depth and session statistics of the matching visitors."""
    chosen = match.filter("fails = 0 AND range_fails = 0").select("user_id")
    events = model.events.join(chosen, "user_id", "left_semi")
    per_event = events.groupBy("user_id").agg(F.expr("count(*) AS n"), F.expr("bool_or(size(survey_answers) > 0) AS identified"))
    warm = model.positives.groupBy("user_id").agg(F.expr("count(*) AS liked"))
    disliked = model.negatives.groupBy("user_id").agg(F.expr("count(*) AS disliked"))
    people = (
        chosen.join(per_event, "user_id", "left").join(warm, "user_id", "left").join(disliked, "user_id", "left")
        .agg(
            F.expr("count(*) AS members"), F.expr("sum(coalesce(n, 0)) AS events"), F.expr("count_if(identified) AS identified"),
            F.expr("count_if(liked IS NOT NULL) AS warm"), F.expr("count_if(identified AND liked IS NOT NULL) AS identified_warm"),
            F.expr("sum(coalesce(liked, 0)) AS positive"), F.expr("sum(coalesce(disliked, 0)) AS negative"),
        )
    )
    views = model.signals.join(chosen, "user_id", "left_semi").agg(
        F.expr("coalesce(sum(visits), 0) AS views"),
        F.expr("coalesce(sum(IF(dwell_seconds > 0, dwell_seconds, 0D)), 0D) AS dwell"),
        F.expr("coalesce(sum(IF(dwell_seconds > 0, visits, 0)), 0) AS dwell_views"),
    )
    sessions = cohort_sessions(events)
    n_sessions = sessions.agg(F.count("*")).scalar()
    only_served = served.select("user_id").distinct().join(match.select("user_id"), "user_id", "left_anti").agg(F.count("*")).scalar()
    median = median_session(sessions).scalar()
    one = people.withColumn("v", F.struct(*[views.select(c).scalar().alias(c) for c in ("views", "dwell", "dwell_views")]))
    return (
        one.withColumn("sessions", n_sessions).withColumn("median_session_seconds", median).withColumn("served_only", only_served)
        .selectExpr(
            f"members + {'0' if filtered else 'served_only'} AS visitors", "warm", "identified", "identified_warm", "events",
            "positive", "negative", "sessions", "coalesce(median_session_seconds, 0D) AS median_session_seconds",
            "v.views AS views", "coalesce(try_divide(v.dwell, v.dwell_views), 0D) AS avg_dwell_seconds",
        )
        .selectExpr(
            "*", "visitors - warm AS cold", "visitors - identified AS anonymous",
            "coalesce(try_divide(views, visitors), 0D) AS views_per_visitor",
        )
    )


def end_reasons(match: DataFrame, signals: DataFrame) -> DataFrame:
    chosen = match.filter("fails = 0 AND range_fails = 0").select("user_id")
    return signals.filter("end_reason IS NOT NULL").join(chosen, "user_id", "left_semi").groupBy("end_reason").agg(
        F.expr("count(*) AS views")
    )


def feedback_summary(match: DataFrame, scores: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """(question, score, n, avg, total): each question against the ranges of the others."""
    own = " OR ".join(f"(question = {sv.sql_text(q)} AND NOT score BETWEEN {lo} AND {hi})" for q, (lo, hi) in ranges.items()) or "false"
    rows = match.filter("fails = 0 AND range_fails <= 1").select("user_id", "range_fails").join(scores, "user_id")
    counted = rows.filter(f"range_fails = 0 OR {own}").groupBy("question", "score").agg(F.expr("count(*) AS n"))
    return counted.selectExpr(
        "question", "score", "n", "sum(n) OVER (PARTITION BY question) AS total",
        "sum(n * score) OVER (PARTITION BY question) / sum(n) OVER (PARTITION BY question) AS avg",
    )


def timeline(events: DataFrame) -> DataFrame:
    """Per UTC day: distinct visitors, those who ever responded, the rest, and events."""
    daily = events.selectExpr("user_id", "to_date(ts) AS date", "size(survey_answers) > 0 AS answered").groupBy("date", "user_id").agg(
        F.expr("count(*) AS n"), F.expr("bool_or(answered) AS answered")
    )
    ever = daily.filter("answered").select("user_id").distinct().withColumn("responded", F.lit(True))
    return daily.join(ever, "user_id", "left").groupBy("date").agg(
        F.expr("count(*) AS visitors"), F.expr("count_if(responded) AS responded"),
        F.expr("count_if(responded IS NULL) AS anonymous"), F.expr("sum(n) AS events"),
    )


def content_stats(signals: DataFrame, seen: DataFrame, contents: DataFrame) -> DataFrame:
    """Per item: views, exposed visitors, mean dwell, likes and like rate."""
    used = signals.groupBy("content_id").agg(
        F.expr("sum(visits) AS views"), F.expr("sum(coalesce(dwell_seconds, 0D)) AS dwell"), F.expr("count_if(outcome = 'positive') AS positive")
    )
    exposed = seen.select("user_id", "content_id").distinct().groupBy("content_id").agg(F.expr("count(*) AS users"))
    joined = exposed.join(used, "content_id", "left").join(contents.select("content_id", "title"), "content_id", "left")
    return joined.selectExpr(
        "content_id", "coalesce(title, '') AS title", "coalesce(views, 0) AS views", "users",
        "coalesce(try_divide(dwell, views), 0D) AS avg_dwell", "coalesce(positive, 0) AS positive",
        "coalesce(positive, 0) / users AS positive_rate",
    )


def popular_themes(affinity: DataFrame, limit: int = 40) -> DataFrame:
    """Tag keys by the number of visitors who lean towards them."""
    root = "substring_index(substring_index(key, ':', 1), '.', 1)"
    counts = affinity.filter(f"weight > 0 AND {root} IN ({sv.sql_list(THEME_ROOTS)})").groupBy("key").agg(F.expr("count(*) AS visitors"))
    return counts.orderBy(F.desc("visitors"), "key").limit(limit)


def cluster_preferences(members: DataFrame, positives: DataFrame, affinity: DataFrame, contents: DataFrame,
                        top_items: int = 5, top_themes: int = 6) -> DataFrame:
    """(cluster, kind, rank, id, amount): most liked items and strongest themes of each cluster."""
    likes = members.join(positives, "user_id").groupBy("cluster", "content_id").agg(F.expr("CAST(count(*) AS DOUBLE) AS amount"))
    likes = top_k(likes, ["cluster"], [F.desc("amount"), F.col("content_id")], top_items, rank="rank")
    items = likes.join(contents.select("content_id", "title"), "content_id", "left").selectExpr(
        "cluster", "'content' AS kind", "rank", "content_id AS id", "coalesce(title, '') AS label", "amount")
    themes = members.join(affinity.select("user_id", "key", "weight"), "user_id").groupBy("cluster", "key").agg(F.expr("sum(weight) AS amount"))
    themes = top_k(themes, ["cluster"], [F.expr("round(amount, 9)").desc(), F.col("key")], top_themes, rank="rank").selectExpr(
        "cluster", "'theme' AS kind", "rank", "key AS id", "regexp_replace(key, '^[^:]*:', '') AS label", "amount")
    return items.unionByName(themes)


def content_spread(contents: DataFrame, signals: DataFrame) -> DataFrame:
    """Supply against demand: located or dated items with their view counts."""
    views = signals.groupBy("content_id").agg(F.expr("sum(visits) AS views"))
    placed = contents.filter("(lat IS NOT NULL AND lon IS NOT NULL) OR size(years) > 0")
    return placed.join(views, "content_id", "left").selectExpr(
        "content_id", "coalesce(nullif(title, ''), content_id) AS title", "lat", "lon", "years", "coalesce(views, 0) AS views"
    )


def coverage(contents: DataFrame) -> DataFrame:
    return contents.agg(
        F.expr("count(*) AS items"), F.expr("count_if(lat IS NOT NULL AND lon IS NOT NULL) AS with_geo"),
        F.expr("count_if(size(years) > 0) AS with_dates"),
    )


def vocabulary(tags: DataFrame) -> DataFrame:
    """(facet, label, key, items): the whole tag vocabulary with usage counts."""
    return tags.groupBy("facet", "label").agg(F.expr("count(*) AS items")).selectExpr(
        "facet", "label", "concat(facet, ':', label) AS key", "items"
    )


def facet_labels(content_tags: DataFrame) -> DataFrame:
    """(facet, place, label): the sorted labels of each facet. A window reads one facet's labels, never its items."""
    labels = content_tags.select("facet", "label").distinct()
    return labels.withColumn("place", F.expr("row_number() OVER (PARTITION BY facet ORDER BY label)")).select("facet", "place", "label")


def serving_metrics(served: DataFrame, items: DataFrame, events: DataFrame) -> DataFrame:
    """One row of serving counters from the durable logs."""
    totals = served.agg(F.expr("count(*) AS recommends"), F.expr("count_if(strategy = 'cold') AS cold"))
    placed = items.agg(
        F.expr("count(*) AS items_total"),
        F.expr("count(DISTINCT IF(role = 'distractor', request_id, NULL)) AS distractor_placed"),
    )
    return (
        totals.withColumn("items_total", placed.select("items_total").scalar())
        .withColumn("distractor_placed", placed.select("distractor_placed").scalar())
        .withColumn("ingests", events.agg(F.count("*")).scalar())
        .selectExpr(
            "*", "recommends - cold AS warm", "cold / greatest(recommends, 1) AS cold_rate",
            "items_total / greatest(recommends, 1) AS avg_items", "distractor_placed / greatest(recommends, 1) AS distractor_rate",
        )
    )


def served_counts(served: DataFrame) -> DataFrame:
    return served.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.expr("count(*) AS n_served"), F.expr("max(ts) AS served_last")
    )


def _as_map(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(user_id, name): a map of each visitor's few keys; rows have one value for a key."""
    return rows.groupBy("user_id").agg(F.expr(f"map_from_entries(array_sort(collect_list(struct({key}, {value})))) AS {name}"))


def visitor_profiles(model, served: DataFrame, segments: DataFrame, scores: DataFrame, values: DataFrame) -> DataFrame:
    """`visitors_table` with its segment, feedback (question -> score) and demographics (field -> canonical value).

    scores: user_id, question, score; values: user_id, field, value. Questions and fields are a fixed few, so the maps are
    small. A visitor known from a segment, an answer or the external provider only has a row too.
    """
    rows = visitors_table(model, served, segments)
    rows = rows.join(_as_map(scores, "question", "score", "feedback"), "user_id", "left")
    return rows.join(_as_map(values, "field", "value", "demographics"), "user_id", "full_outer").withColumns({
        "cold": F.expr("coalesce(cold, true)"), "anonymous": F.expr("coalesce(anonymous, true)"),
        **{c: F.expr(f"coalesce({c}, 0)") for c in ("n_views", "n_interactions", "n_served", "n_liked", "n_seen")}})


def visitors_table(model, served: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """One row per known visitor: activity, likes, serves, segment, anonymity."""
    activity = model.events.groupBy("user_id").agg(
        F.expr("count(*) AS n_interactions"), F.expr("max(ts) AS last_ts"), F.expr("bool_or(size(survey_answers) > 0) AS answered")
    )
    seen = model.signals.groupBy("user_id").agg(
        F.expr("sum(visits) AS n_views"), F.expr("count(*) AS n_seen"), F.expr("count_if(outcome = 'positive') AS n_liked")
    )
    rows = activity.join(seen, "user_id", "left").join(served_counts(served), "user_id", "full_outer")
    if segments is None:
        rows = rows.withColumn("segment", F.lit(None).cast("string"))
    else:
        rows = rows.join(segments.select("user_id", "segment"), "user_id", "full_outer")
    return rows.selectExpr(
        "user_id", "NOT coalesce(answered, false) AS anonymous", "coalesce(n_views, 0) AS n_views",
        "coalesce(n_interactions, 0) AS n_interactions", "coalesce(n_served, 0) AS n_served",
        "coalesce(last_ts, served_last) AS last_interaction", "coalesce(n_liked, 0) AS n_liked",
        "coalesce(n_seen, 0) AS n_seen", "coalesce(n_liked, 0) = 0 AS cold", "segment",
    )
