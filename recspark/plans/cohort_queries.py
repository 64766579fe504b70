"""Queries of sessions, cohort statistics, content statistics and the served log."""

from __future__ import annotations

from pyspark.sql import functions as F

from recspark.functions import survey as sv
from recspark.operators import cohort as co
from recspark.operators import sessions as se
from recspark.plans import bindings as b
from recspark.plans.oracle import cte
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import World

FILTERS = {"gender": {"female", "non_binary"}, "nationality": {"dutch", "german", "nation_3", "polish"}}
RANGES = {"boring": (2, 5)}

cte("gap_marks", """
SELECT user_id, event_id, ts, event, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END AS gap
FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM iev)
""")
cte("cohort_sess", """
SELECT user_id, min(ts) AS s, max(ts) AS e FROM (
  SELECT *, sum(CASE WHEN gap = 1 OR event = 'SESSION_STARTED' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM gap_marks)
GROUP BY user_id, sid HAVING max(ts) > min(ts)
""")
cte("marker_sess", """
SELECT user_id, ts AS s, coalesce(nx, (SELECT max(ts) FROM iev i WHERE i.user_id = m.user_id)) AS e FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM iev WHERE event IN ('SESSION_STARTED', 'SESSION_ENDED')) m
WHERE event = 'SESSION_STARTED'
""")
cte("hist_sess", """
SELECT user_id, s, e FROM marker_sess
UNION ALL SELECT user_id, min(ts), max(ts) FROM (
  SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM gap_marks WHERE user_id NOT IN (SELECT user_id FROM marker_sess))
GROUP BY user_id, sid
""")
cte("surv_spans", """
SELECT user_id, pts AS s, ts AS e, event AS ended FROM (
  SELECT *, lag(ts) OVER w AS pts, lag(event) OVER w AS pev FROM iev WHERE event IN ('SURVEY_PRESENTED', 'SURVEY_SUBMITTED', 'SURVEY_DISMISSED') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event <> 'SURVEY_PRESENTED' AND pev = 'SURVEY_PRESENTED'
""")
cte("demo_canon", """
SELECT u.user_id, age, CASE gender WHEN 'Nonbinary' THEN 'non_binary' WHEN 'Vrouw.' THEN 'female' ELSE gender END AS gender,
  CASE nationality WHEN 'germany' THEN 'german' WHEN 'Poolse' THEN 'polish' WHEN 'new zealand' THEN 'new_zealander' ELSE lower(nationality) END AS nationality,
  lower(replace(province, '-', '_')) AS province,
  CASE personal_connection WHEN 'nee' THEN 'no' WHEN 'Ik weet het niet' THEN 'unknown' ELSE personal_connection END AS personal_connection, email_shared
FROM (SELECT DISTINCT user_id FROM iev) u LEFT JOIN demo d ON d.user_id = u.user_id
""")
cte("fb", """
SELECT user_id, unnest(['interest', 'boring']) AS question, unnest([i, b]) AS score FROM (
  SELECT user_id, CAST(arg_max(event_id % 5 + 1, ts) AS INTEGER) AS i, CAST(arg_max((event_id // 5) % 5 + 1, ts) AS INTEGER) AS b
  FROM iev WHERE event = 'SURVEY_SUBMITTED' GROUP BY user_id)
""")
cte("matched_users", """
SELECT d.*, coalesce(gender, 'no_answer') IN ('female', 'non_binary') AS ok_g, coalesce(nationality, '') IN ('dutch', 'german', 'nation_3', 'polish') AS ok_n,
  EXISTS (SELECT 1 FROM fb WHERE fb.user_id = d.user_id AND question = 'boring' AND score BETWEEN 2 AND 5) AS ok_f FROM demo_canon d
""")


class CohortWorld(World):
    @property
    def scores(self):
        return sv.feedback_scores(self.model.events)

    @property
    def match(self):
        return co.matched(self.model.events.select("user_id").distinct(), self.model.demographics, self.scores, FILTERS, RANGES)


@query("paired_dwell", """
SELECT user_id, content_id AS item_id, epoch_us(ts) AS start_us, round((epoch_us(nx) - epoch_us(ts)) / 1e6, 6) AS dwell_seconds FROM (
  SELECT *, lead(ts) OVER (PARTITION BY user_id, content_id ORDER BY ts, event_id) AS nx FROM iev WHERE content_id IS NOT NULL)
WHERE event = 'CONTENT_VIEW_STARTED' AND nx IS NOT NULL
""")
def paired_dwell(spark, sf_dir):
    raw = World(spark, sf_dir).events.filter("content_id IS NOT NULL").selectExpr(
        "user_id", "content_id AS item_id", "event_id", "IF(event = 'CONTENT_VIEW_STARTED', 'start', 'end') AS event_type", "ts")
    return se.paired_dwell(raw).selectExpr("user_id", "item_id", "unix_micros(start_ts) AS start_us", *r6("dwell_seconds"))


@query("cohort_sessions", "SELECT user_id, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM cohort_sess")
def cohort_sessions(spark, sf_dir):
    s = se.cohort_sessions(World(spark, sf_dir).events)
    return s.selectExpr("user_id", "unix_micros(start) AS start_us", "unix_micros(end) AS end_us")


@query("median_session", """
SELECT round((epoch_us(e) - epoch_us(s)) / 1e6, 6) AS median_seconds FROM cohort_sess ORDER BY epoch_us(e) - epoch_us(s) LIMIT 1 OFFSET (SELECT count(*) // 2 FROM cohort_sess)
""")
def median_session(spark, sf_dir):
    return se.median_session(se.cohort_sessions(World(spark, sf_dir).events)).selectExpr(*r6("median_seconds"))


@query("history_sessions", "SELECT user_id, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM hist_sess")
def history_sessions(spark, sf_dir):
    s = se.history_sessions(World(spark, sf_dir).events)
    return s.selectExpr("user_id", "unix_micros(start) AS start_us", "unix_micros(end) AS end_us")


@query("survey_spans", "SELECT user_id, epoch_us(s) AS start_us, epoch_us(e) AS end_us, ended FROM surv_spans")
def survey_spans(spark, sf_dir):
    s = se.survey_spans(World(spark, sf_dir).events)
    return s.selectExpr("user_id", "unix_micros(start) AS start_us", "unix_micros(end) AS end_us", "ended")


@query("journey", """
SELECT 'session' AS kind, h.user_id, epoch_us(h.s) AS start_us, epoch_us(h.e) AS end_us,
  (SELECT count(*) FROM iev i WHERE i.user_id = h.user_id AND i.ts BETWEEN h.s AND h.e) AS n_events,
  (SELECT count(*) FROM iev i WHERE i.user_id = h.user_id AND i.ts BETWEEN h.s AND h.e AND event = 'CONTENT_VIEW_STARTED') AS n_views,
  (SELECT count(*) FROM surv_spans v WHERE v.user_id = h.user_id AND v.s BETWEEN h.s AND h.e) AS n_surveys, NULL AS ended FROM hist_sess h
UNION ALL SELECT 'survey', v.user_id, epoch_us(v.s), epoch_us(v.e), 0, 0, 0, ended FROM surv_spans v
WHERE NOT EXISTS (SELECT 1 FROM hist_sess h WHERE h.user_id = v.user_id AND v.s BETWEEN h.s AND h.e)
""")
def journey(spark, sf_dir):
    rows = se.journey(World(spark, sf_dir).events)
    return rows.selectExpr("kind", "user_id", "unix_micros(start) AS start_us", "unix_micros(end) AS end_us", "n_events", "n_views", "n_surveys", "ended")


@query("faceted_counts", """
SELECT field, value, count(*) AS visitors FROM (
  SELECT 'age' AS field, age AS value, ok_g AND ok_n AS ok FROM matched_users WHERE ok_f
  UNION ALL SELECT 'gender', gender, ok_n FROM matched_users WHERE ok_f UNION ALL SELECT 'nationality', nationality, ok_g FROM matched_users WHERE ok_f
  UNION ALL SELECT 'province', province, ok_g AND ok_n FROM matched_users WHERE ok_f UNION ALL SELECT 'personal_connection', personal_connection, ok_g AND ok_n FROM matched_users WHERE ok_f
  UNION ALL SELECT 'email_shared', email_shared, ok_g AND ok_n FROM matched_users WHERE ok_f) WHERE ok AND value IS NOT NULL GROUP BY field, value
""")
def faceted_counts(spark, sf_dir):
    return co.faceted_counts(CohortWorld(spark, sf_dir).match, FILTERS)


@query("cohort_behavior", """
SELECT count(*) AS visitors, count(*) FILTER (EXISTS (SELECT 1 FROM pos_items p WHERE p.user_id = m.user_id)) AS warm,
  count(*) FILTER (NOT EXISTS (SELECT 1 FROM pos_items p WHERE p.user_id = m.user_id)) AS cold,
  CAST(sum((SELECT count(*) FROM iev i WHERE i.user_id = m.user_id)) AS BIGINT) AS events, CAST(sum((SELECT sum(visits) FROM views_agg v WHERE v.user_id = m.user_id)) AS BIGINT) AS views,
  CAST(sum((SELECT count(*) FROM pos_items p WHERE p.user_id = m.user_id)) AS BIGINT) AS positive, CAST(sum((SELECT count(*) FROM neg_items p WHERE p.user_id = m.user_id)) AS BIGINT) AS negative,
  (SELECT count(*) FROM cohort_sess c JOIN matched_users m2 USING (user_id) WHERE ok_g AND ok_n AND ok_f) AS sessions,
  round((SELECT sum(dwell) / sum(visits) FROM views_agg v JOIN matched_users m2 USING (user_id) WHERE ok_g AND ok_n AND ok_f AND dwell > 0), 6) AS avg_dwell_seconds
FROM matched_users m WHERE ok_g AND ok_n AND ok_f
""")
def cohort_behavior(spark, sf_dir):
    w = CohortWorld(spark, sf_dir, stored=True)
    out = co.cohort_behavior(w.match, w.model, b.served(spark, sf_dir), filtered=True)
    return out.selectExpr("visitors", "warm", "cold", "events", "views", "positive", "negative", "sessions", *r6("avg_dwell_seconds"))


@query("end_reasons", "SELECT end_reason, count(*) AS views FROM views_agg JOIN matched_users USING (user_id) WHERE ok_g AND ok_n AND ok_f AND end_reason IS NOT NULL GROUP BY end_reason")
def end_reasons(spark, sf_dir):
    w = CohortWorld(spark, sf_dir)
    return co.end_reasons(w.match, w.model.views)


@query("feedback_summary", """
SELECT question, score, count(*) AS n, sum(count(*)) OVER (PARTITION BY question)::BIGINT AS total,
  round(sum(count(*) * score) OVER (PARTITION BY question) / sum(count(*)) OVER (PARTITION BY question), 6) AS avg
FROM fb JOIN matched_users m USING (user_id) WHERE ok_g AND ok_n AND (ok_f OR question = 'boring') GROUP BY question, score
""")
def feedback_summary(spark, sf_dir):
    w = CohortWorld(spark, sf_dir)
    return co.feedback_summary(w.match, w.scores, RANGES).selectExpr("question", "score", "n", "total", *r6("avg"))


@query("feedback_scores", "SELECT user_id, question, score FROM fb")
def feedback_scores(spark, sf_dir):
    return CohortWorld(spark, sf_dir).scores


@query("timeline", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, count(DISTINCT user_id) AS visitors, count(DISTINCT CASE WHEN r THEN user_id END) AS responded,
  count(DISTINCT CASE WHEN NOT r THEN user_id END) AS anonymous, count(*) AS events
FROM (SELECT *, bool_or(event IN ('IDENTIFY', 'SURVEY_SUBMITTED') OR rating IS NOT NULL) OVER (PARTITION BY user_id) AS r FROM iev) GROUP BY 1
""")
def timeline(spark, sf_dir):
    return co.timeline(World(spark, sf_dir).events).withColumn("date", F.expr("CAST(date AS STRING)"))


@query("content_stats", """
SELECT e.content_id, 'Item ' || e.content_id AS title, coalesce(views, 0) AS views, users, round(coalesce(dwell / views, 0), 6) AS avg_dwell, coalesce(positive, 0) AS positive,
  round(coalesce(positive, 0) / users, 6) AS positive_rate
FROM (SELECT content_id, count(DISTINCT user_id) AS users FROM views_agg GROUP BY 1) e
LEFT JOIN (SELECT content_id, CAST(sum(visits) AS BIGINT) AS views, sum(coalesce(dwell, 0)) AS dwell, count(*) FILTER (outcome = 'positive') AS positive FROM scored_views GROUP BY 1) u USING (content_id)
""")
def content_stats(spark, sf_dir):
    w = World(spark, sf_dir)
    return co.content_stats(w.model.signals, w.model.views, w.contents).selectExpr(
        "content_id", "title", "views", "users", "positive", *r6("avg_dwell", "positive_rate"))


@query("popular_themes", """
SELECT key, count(*) AS visitors FROM affinity WHERE weight > 0 AND split_part(split_part(key, ':', 1), '.', 1) IN ('theme_what', 'theme_how', 'place_where', 'location')
GROUP BY key ORDER BY visitors DESC, key LIMIT 40
""")
def popular_themes(spark, sf_dir):
    return co.popular_themes(World(spark, sf_dir).model.tag_affinity)


@query("content_spread", """
SELECT content_id, 'Item ' || content_id AS title, round(lat, 6) AS lat, round(lon, 6) AS lon, year,
  coalesce((SELECT CAST(sum(visits) AS BIGINT) FROM views_agg v WHERE v.content_id = c.content_id), 0) AS views FROM cont c
""")
def content_spread(spark, sf_dir):
    w = World(spark, sf_dir)
    rows = co.content_spread(w.contents, w.model.views)
    return rows.selectExpr("content_id", "title", *r6("lat", "lon"), "CAST(years[0] AS BIGINT) AS year", "views")


@query("coverage", "SELECT count(*) AS items, count(lat) AS with_geo, count(year) AS with_dates FROM cont")
def coverage(spark, sf_dir):
    return co.coverage(World(spark, sf_dir).contents)


@query("tag_vocabulary", "SELECT facet, label, facet || ':' || label AS key, count(*) AS items FROM ctags GROUP BY facet, label")
def tag_vocabulary(spark, sf_dir):
    return co.vocabulary(World(spark, sf_dir).content_tags)


@query("facet_labels", "SELECT facet, CAST(row_number() OVER (PARTITION BY facet ORDER BY label) AS INTEGER) AS place, label FROM (SELECT DISTINCT facet, label FROM ctags)")
def facet_labels(spark, sf_dir):
    return co.facet_labels(World(spark, sf_dir).content_tags)


@query("serving_metrics", """
SELECT recommends, cold, recommends - cold AS warm, (SELECT count(*) FROM served_lines) AS items_total, (SELECT count(DISTINCT request_id) FROM served_lines WHERE rank = 3) AS distractor_placed,
  (SELECT count(*) FROM events) AS ingests, round(cold / recommends, 6) AS cold_rate, round((SELECT count(*) FROM served_lines) / recommends, 6) AS avg_items,
  round((SELECT count(DISTINCT request_id) FROM served_lines WHERE rank = 3) / recommends, 6) AS distractor_rate
FROM (SELECT count(*) AS recommends, count(*) FILTER (o_orderstatus = 'P') AS cold FROM orders)
""")
def serving_metrics(spark, sf_dir):
    m = co.serving_metrics(b.served(spark, sf_dir), b.served_items(spark, sf_dir), World(spark, sf_dir).events)
    return m.selectExpr("recommends", "cold", "warm", "items_total", "distractor_placed", "ingests", *r6("cold_rate", "avg_items", "distractor_rate"))


cte("visitor_rows", """
SELECT coalesce(a.user_id, s.user_id) AS user_id, NOT coalesce(answered, false) AS anonymous, coalesce(n_views, 0) AS n_views, coalesce(n_interactions, 0) AS n_interactions,
  coalesce(n_served, 0) AS n_served, epoch_us(coalesce(last_ts, served_last)) AS last_us, coalesce(n_liked, 0) AS n_liked, coalesce(n_seen, 0) AS n_seen, coalesce(n_liked, 0) = 0 AS cold
FROM (SELECT user_id, count(*) AS n_interactions, max(ts) AS last_ts, bool_or(event IN ('IDENTIFY', 'SURVEY_SUBMITTED') OR rating IS NOT NULL) AS answered FROM iev GROUP BY user_id) a
LEFT JOIN (SELECT user_id, CAST(sum(visits) AS BIGINT) AS n_views, count(*) AS n_seen, count(*) FILTER (outcome = 'positive') AS n_liked FROM scored_views GROUP BY user_id) v ON v.user_id = a.user_id
FULL OUTER JOIN (SELECT CAST(o_custkey AS VARCHAR) AS user_id, count(*) AS n_served, max(o_orderdate) AS served_last FROM orders GROUP BY 1) s ON s.user_id = a.user_id
""")


@query("visitors_table", "SELECT * FROM visitor_rows")
def visitors_table(spark, sf_dir):
    w = World(spark, sf_dir)
    rows = co.visitors_table(w.model, b.served(spark, sf_dir))
    return rows.selectExpr("user_id", "anonymous", "n_views", "n_interactions", "n_served", "unix_micros(last_interaction) AS last_us", "n_liked", "n_seen", "cold")


@query("served_only_visitors", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def served_only_visitors(spark, sf_dir):
    served = b.served(spark, sf_dir).select("user_id").distinct()
    return served.join(World(spark, sf_dir).events.select("user_id"), "user_id", "left_anti")
