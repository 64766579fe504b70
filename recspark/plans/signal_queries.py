"""Queries of the visitor model: views, engagement, affinity, taste, survey profile."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.config import RecConfig
from recspark.functions import survey as sv
from recspark.operators import signals as sg
from recspark.plans import bindings as b
from recspark.plans.oracle import cte
from recspark.plans.registry import query, r6

CFG = RecConfig()


@dataclass(frozen=True)
class World:
    """The engine's tables over one directory of driver tables."""

    spark: SparkSession
    sf_dir: str
    stored: bool = False

    @cached_property
    def events(self) -> DataFrame:
        return b.interactions(self.spark, self.sf_dir)

    @cached_property
    def contents(self) -> DataFrame:
        return b.contents(self.spark, self.sf_dir)

    @cached_property
    def content_tags(self) -> DataFrame:
        return b.content_tags(self.spark, self.sf_dir)

    @cached_property
    def vectors(self) -> DataFrame:
        return b.vectors(self.spark, self.sf_dir)

    @cached_property
    def provider(self) -> DataFrame:
        return b.provider(self.spark, self.sf_dir)

    @cached_property
    def model(self) -> sg.VisitorModel:
        return sg.VisitorModel(self.events, self.contents, self.content_tags, self.vectors, b.NOW, CFG, self.provider,
                               stored=self.stored)


@query("item_signals", """
SELECT user_id, content_id, strength_r AS strength, outcome, round(decay, 6) AS decay, round(dratio, 6) AS dwell_ratio,
       round(CASE outcome WHEN 'positive' THEN greatest(strength, 0.0) * decay WHEN 'negative' THEN abs(strength) * decay END, 6) AS weight
FROM (SELECT *, round(strength, 6) AS strength_r FROM scored_views)
""")
def item_signals(spark, sf_dir):
    return World(spark, sf_dir).model.signals.selectExpr(
        "user_id", "content_id", "outcome", *r6("strength", "decay", "dwell_ratio", "weight"))


@query("view_aggregates", """
SELECT user_id, content_id, CAST(visits AS BIGINT) AS visits, round(dwell, 6) AS dwell_seconds, end_reason,
       epoch_us(last_ts) AS last_us, rating AS survey_rating FROM views_agg
""")
def view_aggregates(spark, sf_dir):
    return World(spark, sf_dir).model.views.selectExpr(
        "user_id", "content_id", "CAST(visits AS BIGINT) AS visits", *r6("dwell_seconds"), "end_reason",
        "unix_micros(last_ts) AS last_us", "survey_rating")


@query("negative_items", "SELECT user_id, content_id, round(weight, 6) AS weight FROM neg_items")
def negative_items(spark, sf_dir):
    return World(spark, sf_dir).model.negatives.selectExpr("user_id", "content_id", *r6("weight"))


@query("tag_affinity", "SELECT user_id, key, round(weight, 6) AS weight FROM affinity")
def tag_affinity(spark, sf_dir):
    return World(spark, sf_dir).model.tag_affinity.selectExpr("user_id", "key", *r6("weight"))


@query("tag_aversion", "SELECT user_id, key, round(weight, 6) AS weight FROM aversion")
def tag_aversion(spark, sf_dir):
    return World(spark, sf_dir).model.tag_aversion.selectExpr("user_id", "key", *r6("weight"))


@query("survey_tag_weights", """
SELECT user_id, key, round(sum(CAST(amount AS DOUBLE)), 6) AS amount FROM survey_tags GROUP BY user_id, key
""")
def survey_tag_weights(spark, sf_dir):
    w = sg.survey_tag_weights(World(spark, sf_dir).events)
    return w.groupBy("user_id", "key").agg(F.expr("round(sum(amount), 6) AS amount"))


@query("demographics", "SELECT * FROM demo")
def demographics(spark, sf_dir):
    return World(spark, sf_dir).model.demographics


@query("demographic_tag_weights", "SELECT user_id, key, CAST(amount AS DOUBLE) AS amount FROM demo_tags")
def demographic_tag_weights(spark, sf_dir):
    return sg.demographic_tag_weights(World(spark, sf_dir).model.demographics)


@query("taste_vectors", """
SELECT user_id, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) + 0.0 AS value
FROM (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM taste)
""")
def taste_vectors(spark, sf_dir):
    t = World(spark, sf_dir).model.taste.selectExpr("user_id", "posexplode(taste) AS (dim, value)")
    return t.selectExpr("user_id", "dim", *r6("value"))


@query("recency_items", """
SELECT user_id, arg_min(content_id, (-epoch_us(last_ts), content_id)) AS content_id FROM views_agg GROUP BY user_id
""")
def recency_items(spark, sf_dir):
    return sg.latest_view(World(spark, sf_dir).model.views)


@query("recent_views", """
SELECT user_id, content_id, CAST(rn AS INTEGER) AS recency_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, content_id) AS rn FROM views_agg) WHERE rn <= 20
""")
def recent_views(spark, sf_dir):
    return sg.recent_views(World(spark, sf_dir).model.views, 20).select("user_id", "content_id", "recency_rank")


@query("behavior_stats", """
SELECT coalesce(a.user_id, n.user_id) AS user_id, coalesce(n_views, 0) AS n_views, coalesce(n_positive, 0) AS n_positive,
       coalesce(n_negative, 0) AS n_negative, round(coalesce(avg_dwell_ratio, 0), 6) AS avg_dwell_ratio,
       round(coalesce(completion_rate, 0), 6) AS completion_rate, round(coalesce(revisit_rate, 0), 6) AS revisit_rate,
       round(coalesce(depth, 0), 6) AS depth
FROM (SELECT user_id, count(*) AS n_views, count(*) FILTER (outcome = 'positive') AS n_positive, avg(dratio) AS avg_dwell_ratio,
        avg(CASE WHEN end_reason = 'next_button' THEN 1.0 ELSE 0.0 END) AS completion_rate,
        avg(CASE WHEN visits > 1 THEN 1.0 ELSE 0.0 END) AS revisit_rate,
        avg(CASE WHEN outcome = 'positive' THEN 1.0 ELSE 0.0 END) AS depth FROM scored_views GROUP BY user_id) a
FULL OUTER JOIN (SELECT user_id, count(*) AS n_negative FROM neg_items GROUP BY user_id) n ON a.user_id = n.user_id
""")
def behavior_stats(spark, sf_dir):
    return World(spark, sf_dir).model.behavior.selectExpr(
        "user_id", "n_views", "n_positive", "n_negative",
        *r6("avg_dwell_ratio", "completion_rate", "revisit_rate", "depth"))


@query("visitor_sets", """
SELECT kind, user_id, count(*) AS n, min(content_id) AS first_id, max(content_id) AS last_id FROM (
  SELECT 'viewed' AS kind, user_id, content_id FROM views_agg
  UNION ALL SELECT 'positive', user_id, content_id FROM pos_items
  UNION ALL SELECT 'negative', user_id, content_id FROM neg_items) GROUP BY kind, user_id
""")
def visitor_sets(spark, sf_dir):
    m = World(spark, sf_dir).model
    parts = [("viewed", m.signals), ("positive", m.positives), ("negative", m.negatives)]
    rows = None
    for kind, df in parts:
        part = df.select(F.lit(kind).alias("kind"), "user_id", "content_id")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "user_id").agg(
        F.count("*").alias("n"), F.min("content_id").alias("first_id"), F.max("content_id").alias("last_id"))


@query("visitor_history", """
SELECT v.user_id, v.content_id, 'Item ' || v.content_id AS title, CAST(visits AS BIGINT) AS visits, round(dwell, 6) AS dwell_seconds,
       end_reason, epoch_us(last_ts) AS last_us,
       CASE WHEN v.outcome = 'positive' THEN 'positive' WHEN n.content_id IS NOT NULL THEN 'negative' ELSE 'neutral' END AS outcome
FROM scored_views v LEFT JOIN neg_items n ON n.user_id = v.user_id AND n.content_id = v.content_id
""")
def visitor_history(spark, sf_dir):
    w = World(spark, sf_dir)
    rows = sg.history_rows(w.model.signals, w.contents)
    return rows.selectExpr("user_id", "content_id", "title", "CAST(visits AS BIGINT) AS visits", *r6("dwell_seconds"),
                           "end_reason", "unix_micros(last_ts) AS last_us", "outcome")


@query("survey_profile", """
SELECT user_id, section, base, answer, label, score FROM (
  SELECT DISTINCT user_id, 'demographic' AS section, unnest(['age_group','gender','nationality','province','personal_connection']) AS base,
         unnest([age, gender, nationality, province, personal_connection]) AS answer, unnest([age, gender, nationality, province, personal_connection]) AS label,
         CAST(NULL AS INTEGER) AS score FROM identified
  UNION ALL
  SELECT user_id, 'feedback', unnest(['interest','boring']), CAST(unnest([i, b]) AS VARCHAR),
         unnest([['Strongly disagree','Disagree','Undecided','Agree','Strongly agree'][i], ['Strongly disagree','Disagree','Undecided','Agree','Strongly agree'][b]]),
         unnest([i, b])
  FROM (SELECT user_id, CAST(arg_max(event_id % 5 + 1, ts) AS INTEGER) AS i, CAST(arg_max((event_id // 5) % 5 + 1, ts) AS INTEGER) AS b
        FROM iev WHERE event = 'SURVEY_SUBMITTED' GROUP BY user_id)
  UNION ALL SELECT DISTINCT user_id, 'feedback', 'relevance', 'past|future', 'The past|The future', NULL FROM iev WHERE event = 'SURVEY_SUBMITTED'
  UNION ALL SELECT DISTINCT user_id, 'background', 'prior_visit', 'once', 'Yes, once', NULL FROM iev WHERE event = 'SURVEY_SUBMITTED'
  UNION ALL SELECT DISTINCT user_id, 'personalization', 'personalization_theme', 'label-' || (uid % 10) || '|17', 'label-' || (uid % 10) || '|17', NULL FROM iev WHERE event = 'SURVEY_SUBMITTED'
  UNION ALL SELECT user_id, 'background', 'rating', CAST(CAST(arg_max(rating, ts) AS INTEGER) AS VARCHAR), CAST(CAST(arg_max(rating, ts) AS INTEGER) AS VARCHAR), NULL FROM iev WHERE rating IS NOT NULL GROUP BY user_id)
""")
def survey_profile(spark, sf_dir):
    rows = sv.split_answers(World(spark, sf_dir).events)
    return rows.selectExpr("user_id", "section", "base", "concat_ws('|', answer) AS answer",
                           "concat_ws('|', labels) AS label", "score")


cte("canon_rows", """
SELECT user_id, 'age' AS field, age AS value FROM demo WHERE age IS NOT NULL
  UNION ALL SELECT user_id, 'gender', CASE gender WHEN 'Nonbinary' THEN 'non_binary' WHEN 'Vrouw.' THEN 'female' ELSE gender END FROM demo WHERE gender IS NOT NULL
  UNION ALL SELECT user_id, 'nationality', CASE nationality WHEN 'germany' THEN 'german' WHEN 'Poolse' THEN 'polish' WHEN 'new zealand' THEN 'new_zealander' ELSE lower(nationality) END FROM demo WHERE nationality IS NOT NULL
  UNION ALL SELECT user_id, 'province', lower(replace(province, '-', '_')) FROM demo WHERE province IS NOT NULL
  UNION ALL SELECT user_id, 'personal_connection', CASE personal_connection WHEN 'nee' THEN 'no' WHEN 'Ik weet het niet' THEN 'unknown' ELSE personal_connection END FROM demo WHERE personal_connection IS NOT NULL
  UNION ALL SELECT user_id, 'email_shared', email_shared FROM demo WHERE email_shared IS NOT NULL
""")
cte("canon_demo", "SELECT field, value, count(*) AS visitors FROM canon_rows GROUP BY field, value")


@query("canonical_demographics", "SELECT field, value, visitors FROM canon_demo")
def canonical_demographics(spark, sf_dir):
    long = sg.demographic_values(World(spark, sf_dir).model.demographics)
    return long.groupBy("field", "value").agg(F.count("*").alias("visitors"))


@query("demographic_labels", """
SELECT field, value, visitors, CASE WHEN field = 'age' AND starts_with(value, 'under_') THEN '<' || regexp_replace(value, '[^0-9]', '', 'g')
  WHEN field = 'age' THEN replace(replace(value, '_plus', '+'), '_', '–')
  ELSE array_to_string(list_transform(string_split(trim(replace(value, '_', ' ')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS label FROM canon_demo
""")
def demographic_labels(spark, sf_dir):
    """The canonical demographic values as they are shown."""
    return canonical_demographics(spark, sf_dir).withColumn("label", F.expr(sv.demo_label("field", "value")))
