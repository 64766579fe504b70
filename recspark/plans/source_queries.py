"""Queries of the sources: payload and catalogue normalisation, curation, log reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.plans import bindings as b
from recspark.plans.oracle import cte
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import World
from recspark.sources import catalogue as ct
from recspark.sources import logs
from recspark.sources import payloads as pl

PAYLOAD_SQL = """
CASE WHEN event = 'IDENTIFY' THEN to_json(named_struct('type', 'identify', 'userId', user_id, 'timestamp', iso,
       'traits', named_struct('age', CAST(user_id AS INT) % 60 + 18, 'gender', 'female', 'country', CAST(NULL AS STRING))))
     WHEN event_id % 2 = 0 THEN to_json(named_struct('type', 'track', 'event', event, 'userId', IF(event_id % 10 = 4, NULL, user_id),
       'anonymousId', IF(event_id % 20 = 4, NULL, concat('anon-', user_id)), 'timestamp', iso, 'properties', named_struct(
         'content', named_struct('content_id', concat('content_', content_id)), 'details', named_struct('reason', IF(event_id % 6 = 0, 'menu_button', end_reason),
         'dwell_seconds', dwell_seconds, 'request_id', concat('r', event_id)), 'context', named_struct('session_id', 's1',
         'candidates', transform(impressions, c -> named_struct('content_id', concat('content_', c)))))))
     ELSE to_json(named_struct('event', event, 'userId', user_id, 'sentAt', IF(event_id % 5 = 0, 'soon', iso), 'sessionId', 's2', 'properties', named_struct(
         'content', content_id, 'context', named_struct('request_id', concat('c', event_id), 'candidates', impressions), 'answers', array(
         named_struct('question_id', 'q:theme', 'answer_value', 'A', 'question_type', 'multi'), named_struct('question_id', 'q:theme', 'answer_value', 'B', 'question_type', 'multi'),
         named_struct('question_id', 'stars', 'answer_value', CAST(event_id % 5 AS STRING), 'question_type', 'rating'))))) END
"""
cte("payload_truth", """
SELECT event_id, event, CASE WHEN event <> 'IDENTIFY' AND event_id % 10 = 4 THEN 'anon-' || user_id ELSE user_id END AS user_id,
  epoch_us(CASE WHEN event <> 'IDENTIFY' AND event_id % 2 = 1 AND event_id % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END) AS ts_us, content_id,
  CASE WHEN event_id % 2 = 0 THEN dwell END AS dwell_seconds, CASE WHEN event_id % 2 = 0 AND event_id % 6 <> 0 THEN end_reason END AS end_reason,
  CASE WHEN event = 'IDENTIFY' THEN NULL WHEN event_id % 2 = 0 THEN 'r' || event_id ELSE 'c' || event_id END AS request_id,
  CASE WHEN event = 'IDENTIFY' THEN NULL WHEN event_id % 2 = 0 THEN 's1' ELSE 's2' END AS session_id,
  CASE WHEN event = 'CONTENT_VIEW_STARTED' THEN ((k + 1) % 100) || '|' || ((k + 2) % 100) ELSE '' END AS impressions,
  CASE WHEN event = 'IDENTIFY' THEN 'age=' || (uid % 60 + 18) || ';gender=female' WHEN event_id % 2 = 1 THEN 'q:theme=A,B;rating=' || (event_id % 5) || '.0;stars=' || (event_id % 5) ELSE '' END AS answers
FROM iev WHERE event = 'IDENTIFY' OR event_id % 20 <> 4
""")


@query("normalized_events", "SELECT * FROM payload_truth")
def normalized_events(spark, sf_dir):
    e = World(spark, sf_dir).events.selectExpr("*", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS iso")
    bronze = e.selectExpr("event_id", f"{PAYLOAD_SQL} AS value", "TIMESTAMP '2024-02-01 00:00:00' AS ingest_ts")
    shown = "array_join(transform(array_sort(map_keys(survey_answers)), k -> concat(k, '=', array_join(survey_answers[k], ','))), ';') AS answers"
    return pl.normalize_payloads(bronze).selectExpr(
        "event_id", "event", "user_id", "unix_micros(ts) AS ts_us", "content_id", "dwell_seconds", "end_reason", "request_id", "session_id",
        "array_join(impressions, '|') AS impressions", shown)


@query("event_log_roundtrip", """
SELECT event_id, user_id, event, epoch_us(ts) AS ts_us, content_id, CASE WHEN event = 'CONTENT_VIEW_STARTED' THEN 2 ELSE 0 END AS n_impressions FROM iev
""")
def event_log_roundtrip(spark, sf_dir):
    e = World(spark, sf_dir).events
    rows = logs.encode_events(e.withColumn("raw", F.col("event_id").cast("string")))
    back = logs.decode_events(rows)
    return back.selectExpr("CAST(raw AS BIGINT) AS event_id", "user_id", "event", "unix_micros(ts) AS ts_us", "content_id", "size(impressions) AS n_impressions")


@query("snapshot_stats", """
SELECT count(*) AS total_events, count(DISTINCT user_id) AS total_visitors, count(DISTINCT CASE WHEN event IN ('IDENTIFY', 'SURVEY_SUBMITTED') OR rating IS NOT NULL THEN user_id END) AS survey_responded_visitors,
  count(DISTINCT user_id) - count(DISTINCT CASE WHEN event IN ('IDENTIFY', 'SURVEY_SUBMITTED') OR rating IS NOT NULL THEN user_id END) AS anonymous_visitors,
  count(*) FILTER (event = 'CONTENT_VIEW_STARTED') AS content_views, count(*) FILTER (event LIKE 'CONTENT_VIEW%') AS content_view_events FROM iev
""")
def snapshot_stats(spark, sf_dir):
    return logs.snapshot_stats(World(spark, sf_dir).events)


@query("served_tail", """
SELECT request_id, epoch_us(o_orderdate) AS ts_us, (SELECT string_agg(content_id || ':' || rank, '|' ORDER BY rank, content_id) FROM served_lines l WHERE l.request_id = o.request_id) AS items
FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS request_id FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 50) o
""")
def served_tail(spark, sf_dir):
    item = "struct(rank, content_id AS id, role)"
    items = b.served_items(spark, sf_dir).groupBy("request_id").agg(F.expr(f"array_sort(collect_list({item})) AS items"))
    served = b.served(spark, sf_dir).join(items, "request_id", "left")
    tail = logs.served_tail(served, 50)
    return tail.selectExpr("request_id", "unix_micros(ts) AS ts_us", "array_join(transform(items, i -> concat(i.id, ':', i.rank)), '|') AS items")


@query("catalogue_normalized", """
SELECT CAST(vec_id AS VARCHAR) AS content_id, CASE WHEN vec_id % 4 = 0 THEN 'image_item' ELSE 'text_item' END AS content_type, CAST(vec_id % 90 AS INTEGER) AS word_count, vec_id % 3 = 0 AS has_image,
  round(CASE WHEN vec_id % 2 = 0 THEN 50 + vec_id / 1000 END, 6) AS lat, 'label_' || label AS label, (1900 + vec_id % 50) || '|' || (1950 + vec_id % 20) AS years FROM embeddings
""")
def catalogue_normalized(spark, sf_dir):
    payload = """to_json(named_struct('content_type', CASE vec_id % 4 WHEN 0 THEN 'image_item' ELSE 'strange' END, 'title', concat('T', vec_id),
      'word_count', vec_id % 90, 'files_url', IF(vec_id % 3 = 0, array('u'), CAST(array() AS ARRAY<STRING>)),
      'locations', IF(vec_id % 4 = 0, array(named_struct('lat', 50D + vec_id / 1000D, 'lon', 5D)), NULL), 'lat', IF(vec_id % 4 = 2, CAST(50D + vec_id / 1000D AS STRING), NULL), 'lon', '5',
      'tags', array(named_struct('facet', 'theme_what', 'label', concat('label_', label))),
      'time_metadata', named_struct('dates_of_creation', array(concat('ca. ', 1950 + vec_id % 20), concat('12-03-', 1900 + vec_id % 50)))))"""
    rows = b.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", f"{payload} AS payload")
    return ct.normalize_catalogue(rows).selectExpr(
        "content_id", "content_type", "word_count", "has_image", *r6("lat"), "tags[0].label AS label", "array_join(years, '|') AS years")


@query("curated_items", """
SELECT doc_id AS id, length(source || chr(10) || text) AS char_count, len(list_filter(string_split_regex(source || chr(10) || text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS word_count, CASE WHEN doc_id % 3 = 0 THEN 'f' || doc_id END AS image_url, CASE WHEN lang = 'de' THEN '' ELSE lang END AS creator
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND len(list_filter(string_split_regex(source || chr(10) || text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) >= 5
""")
def curated_items(spark, sf_dir):
    items = b.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "source AS title", "text", "IF(lang = 'de', 'unbekannt', lang) AS creator",
                                                             "IF(doc_id % 3 = 0, array(concat('f', doc_id), 'other'), array()) AS files_url")
    dropped = b.table(spark, sf_dir, "labels").filter("toxic = 1").selectExpr("doc_id AS id")
    return ct.curate(items, dropped).selectExpr("id", "CAST(char_count AS BIGINT) AS char_count", "CAST(word_count AS BIGINT) AS word_count", "creator", "image_url")
