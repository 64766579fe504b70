"""Queries of the durable logs, written and read in the run's folder, and of the visitor extras."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from recspark.operators import bandit as bd
from recspark.operators import profile as pf
from recspark.functions import survey as sv
from recspark.plans import bindings as b
from recspark.plans.oracle import cte
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import CFG, World
from recspark.session import run_folder
from recspark.sources import catalogue as ct
from recspark.sources import logs
from recspark.sources import payloads as pl


def _folder(spark) -> str:
    return f"{run_folder(spark)}/logs-{uuid.uuid4().hex}"


@query("event_log_days", "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM iev GROUP BY 1")
def event_log_days(spark, sf_dir):
    """Every event logged, a batch of them twice, read back and compacted."""
    base = _folder(spark)
    events = World(spark, sf_dir).events.withColumn("raw", F.col("event_id").cast("string"))
    even, odd = events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")
    logs.append_events(even, base, batch="even")
    logs.append_events(odd, base, batch="odd")
    logs.append_events(odd, base, batch="odd")  # a retried batch
    logs.append_events(even.filter("event_id % 3 = 0"), base)  # repeated deliveries
    return logs.compact(spark, base, f"{base}/compact", rows_per_file=20_000).select("date", "n")


@query("served_log_samples", """
SELECT request_id, content_id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank = 3 THEN 'distractor' ELSE 'target' END AS role, round(reward, 6) AS reward FROM line_rewards
""")
def served_log_samples(spark, sf_dir):
    """Served lists to the log, back to rows, and on to training samples with their rewards."""
    base = _folder(spark)
    item = "struct(content_id AS id, CAST(rank AS INT) AS rank, role, 0D AS relevance_score, CAST(map() AS MAP<STRING, DOUBLE>) AS breakdown, features)"
    lists = b.served_items(spark, sf_dir).groupBy("request_id").agg(F.expr(f"array_sort(collect_list({item}), (a, b) -> a.rank - b.rank) AS items"))
    nulls = ["CAST(NULL AS STRING) AS filter", "strategy = 'cold' AS cold_start", "'static' AS ranking", "CAST(NULL AS STRING) AS distractor_id"]
    served = b.served(spark, sf_dir).join(lists, "request_id").selectExpr("request_id", "user_id", "ts", "strategy", *nulls, "items")
    logs.append_served(served, base, batch="one")
    rows = logs.served_long(logs.read_served(spark, base))
    samples = bd.training_samples(rows, bd.impression_rewards(b.reward_events(spark, sf_dir), CFG))
    return samples.selectExpr("request_id", "content_id", "rank", "role", *r6("reward"))


@query("event_snapshot", "SELECT event_id, user_id, event, epoch_us(ts) AS ts_us, content_id, CASE WHEN event = 'CONTENT_VIEW_STARTED' THEN 2 ELSE 0 END AS n_impressions FROM iev")
def event_snapshot(spark, sf_dir):
    """The log as gzip CSV, read back."""
    path = f"{_folder(spark)}/snapshot"
    logs.snapshot(World(spark, sf_dir).events.withColumn("raw", F.col("event_id").cast("string")), path)
    back = logs.decode_events(spark.read.option("header", True).option("escape", '"').csv(path))
    return back.selectExpr("CAST(raw AS BIGINT) AS event_id", "user_id", "event", "unix_micros(ts) AS ts_us", "content_id", "size(impressions) AS n_impressions")


@query("log_rejects", "SELECT count(*) FILTER (event_id % 7 = 0 OR event_id % 11 = 0) AS skipped FROM iev")
def log_rejects(spark, sf_dir):
    rows = logs.encode_events(World(spark, sf_dir).events.withColumn("raw", F.col("event_id").cast("string")))
    spoiled = rows.withColumn("user_id", F.expr("IF(raw % 7 = 0, NULL, user_id)")).withColumn("ts", F.expr("IF(raw % 11 = 0, 'soon', ts)"))
    return logs.reject_count(spoiled)


@query("model_versions", "SELECT user_id, content_id, round(weight, 6) AS weight FROM pos_items")
def model_versions(spark, sf_dir):
    """Two versions of a model table; readers take the latest."""
    path = f"{_folder(spark)}/model"
    model = World(spark, sf_dir).model.positives.select("user_id", "content_id", "weight")
    logs.save_model(model.filter("weight > 0.5"), path, 1)
    logs.save_model(model, path, 2)
    return logs.latest_model(spark, path).selectExpr("user_id", "content_id", *r6("weight"))


@query("strongest_keys", """
SELECT user_id, CAST(rank AS INTEGER) AS rank, kind, key, round(round(weight, 9), 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY round(abs(weight), 9) DESC, key) AS rank FROM (
    SELECT user_id, key, weight, 'affinity' AS kind FROM affinity UNION ALL SELECT user_id, key, weight, 'aversion' FROM aversion)) WHERE rank <= 12
""")
def strongest_keys(spark, sf_dir):
    model = World(spark, sf_dir).model
    # Sums of doubles may differ in the last digits, so ties are taken at nine decimals.
    sides = [pf.strongest_keys(t.withColumn("weight", F.round("weight", 9))).withColumn("kind", F.lit(k)) for k, t in (("affinity", model.tag_affinity), ("aversion", model.tag_aversion))]
    return sides[0].unionByName(sides[1]).selectExpr("user_id", "rank", "kind", "key", *r6("weight"))


@query("liked_contents", """
SELECT user_id, CAST(rank AS INTEGER) AS rank, content_id, round(round(weight, 9), 6) AS weight, CASE WHEN content_id IN (SELECT content_id FROM cont) THEN 'Item ' || content_id END AS title,
  coalesce((SELECT string_agg(facet || ':' || label, '|' ORDER BY pos) FROM ctags t WHERE t.content_id = x.content_id), '') AS tags
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, content_id) AS rank FROM pos_items) x WHERE rank <= 15
""")
def liked_contents(spark, sf_dir):
    w = World(spark, sf_dir)
    positives = w.model.positives.withColumn("weight", F.round("weight", 9))
    return pf.liked_contents(positives, w.contents, w.content_tags).selectExpr("user_id", "rank", "content_id", "title", "array_join(tags, '|') AS tags", *r6("weight"))


@query("readable_answers", """
SELECT DISTINCT user_id, 'personalization_theme' AS base, 'Label-' || (uid % 10) || '|17' AS answer FROM iev WHERE event = 'SURVEY_SUBMITTED'
""")
def readable_answers(spark, sf_dir):
    w = World(spark, sf_dir)
    return pf.readable_answers(sv.split_answers(w.events), w.contents).selectExpr("user_id", "base", "array_join(answer, '|') AS answer")


@query("visitor_counts", """
SELECT u.user_id, coalesce(v.n, 0) AS viewed, coalesce(p.n, 0) AS positives, coalesce(g.n, 0) AS negatives, coalesce(v.n, 0) = 0 AS is_cold,
  u.user_id IN (SELECT user_id FROM iev WHERE event = 'SURVEY_SUBMITTED') AS completed_personalization
FROM (SELECT user_id FROM iev UNION SELECT user_id FROM demo_provider) u LEFT JOIN (SELECT user_id, count(*) AS n FROM scored_views GROUP BY 1) v USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM pos_items GROUP BY 1) p USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM neg_items GROUP BY 1) g USING (user_id)
""")
def visitor_counts(spark, sf_dir):
    m = World(spark, sf_dir).model
    counts = pf.visitor_counts(m.users, sv.split_answers(m.events), m.signals, m.positives, m.negatives)
    return counts.select("user_id", "viewed", "positives", "negatives", "is_cold", "completed_personalization")


cte("cont_title", "SELECT *, 'Item ' || content_id AS title FROM cont")
TIMELINE_PAYLOAD = """
to_json(named_struct('event', event, 'userId', user_id, 'timestamp', iso, 'properties', named_struct(
  'content', content_id, 'screen', IF(event_id % 4 = 0, '', concat('s', event_id % 3)), 'visible', event_id % 2 = 0,
  'panel', named_struct('panel_id', event_id % 5, 'panel_name', IF(event_id % 3 = 0, '', 'map'), 'inner', array(1)),
  'details', named_struct('reason', IF(event_id % 6 = 0, 'menu_button', end_reason), 'state', 'detail', 'only', 'd', 'request_id', 'r'),
  'context', named_struct('state', IF(event_id % 5 = 0, '', 'context'), 'session_id', 's', 'candidates', impressions))))
"""
cte("timeline_rows", """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM iev
""")


@query("event_timeline", """
SELECT user_id, CAST(place AS INTEGER) AS place, event_id, epoch_us(ts) AS ts_us, event, coalesce(CASE WHEN content_id IN (SELECT content_id FROM cont) THEN 'Item ' || content_id END, '') AS title,
  concat_ws(';', CASE WHEN event = 'CONTENT_VIEW_STARTED' THEN 'candidates=2' END, 'only=d', 'panel_id=' || (event_id % 5), CASE WHEN event_id % 3 <> 0 THEN 'panel_name=map' END,
    CASE WHEN event_id % 6 = 0 THEN 'reason=menu_button' END, CASE WHEN event_id % 4 <> 0 THEN 'screen=s' || (event_id % 3) END,
    CASE WHEN event_id % 5 <> 0 THEN 'state=context' END, 'visible=' || (event_id % 2 = 0)) AS meta
FROM timeline_rows WHERE place <= 20
""")
def event_timeline(spark, sf_dir):
    w = World(spark, sf_dir)
    e = w.events.selectExpr("*", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS iso")
    bronze = e.selectExpr("event_id", f"{TIMELINE_PAYLOAD} AS value", "ts AS ingest_ts")
    rows = pf.event_timeline(pl.event_metadata(pl.normalize_payloads(bronze)), w.contents, 20)
    return rows.selectExpr("user_id", "place", "event_id", "unix_micros(ts) AS ts_us", "event", "title",
                           "array_join(transform(array_sort(map_entries(meta), (a, b) -> IF(a.key < b.key, -1, 1)), e -> concat(e.key, '=', e.value)), ';') AS meta")


@query("session_view_lines", """
SELECT user_id, content_id, round(dwell, 6) AS dwell_seconds, end_reason, 1 AS visits, epoch_us(ts) AS ts_us FROM iev WHERE event = 'CONTENT_VIEW_ENDED'
""")
def session_view_lines(spark, sf_dir):
    """Views as JSON lines of a visitor's day, a busy day in several, read back as rows."""
    path = f"{_folder(spark)}/sessions"
    ct.write_session_views(World(spark, sf_dir).events.filter("event = 'CONTENT_VIEW_ENDED'"), path, line_views=4)
    return ct.read_session_views(spark, path).selectExpr("user_id", "content_id", "round(dwell_seconds, 6) AS dwell_seconds", "end_reason", "visits", "unix_micros(ts) AS ts_us")


@query("content_lines", """
SELECT content_id, title, word_count, has_image, round(lat, 6) AS lat, round(lon, 6) AS lon,
  (SELECT string_agg(facet || ':' || label || '=' || CAST(round(weight * 10) AS INTEGER), '|' ORDER BY pos) FROM ctags t WHERE t.content_id = c.content_id) AS tags,
  len(v) AS dim, round(list_sum(v), 4) AS total
FROM cont_title c JOIN vec USING (content_id)
""")
def content_lines(spark, sf_dir):
    """The catalogue as JSON lines, read back."""
    w = World(spark, sf_dir)
    path = f"{_folder(spark)}/contents"
    ct.write_content_lines(w.contents, w.content_tags, w.vectors, path)
    back = ct.read_content_lines(spark, path)
    return back.selectExpr("id AS content_id", "title", "word_count", "has_image", "round(lat, 6) AS lat", "round(lon, 6) AS lon",
                           "array_join(transform(tags, t -> concat(t.facet, ':', t.label, '=', CAST(round(t.weight * 10) AS INT))), '|') AS tags",
                           "size(vector) AS dim", "round(aggregate(vector, 0D, (s, x) -> s + x), 4) AS total")


@query("sample_lines", """
SELECT round(sum(list_sum(x)), 3) AS features, round(sum(reward), 4) AS reward, count(*) AS n FROM line_rewards
""")
def sample_lines(spark, sf_dir):
    """Training samples as JSON lines, read back and summed."""
    path = f"{_folder(spark)}/samples"
    samples = bd.training_samples(b.served_items(spark, sf_dir), bd.impression_rewards(b.reward_events(spark, sf_dir), CFG))
    samples.select("features", "reward").write.json(path)
    return ct.read_samples(spark, path).agg(
        F.expr("round(sum(aggregate(features, 0D, (s, x) -> s + x)), 3) AS features"), F.expr("round(sum(reward), 4) AS reward"), F.expr("count(*) AS n"))
