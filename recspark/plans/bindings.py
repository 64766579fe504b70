"""Projections of the driver's tables onto the engine's tables (FIXTURES.md, part B and C)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 31)

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of the mapping: event names, and the answers that identify and survey events carry.
EVENT_SQL = """
CASE WHEN event_type = 'view' THEN 'CONTENT_VIEW_STARTED'
     WHEN event_type IN ('click', 'purchase', 'error') THEN 'CONTENT_VIEW_ENDED'
     ELSE element_at(array('IDENTIFY', 'SURVEY_SUBMITTED', 'SURVEY_PRESENTED', 'SURVEY_DISMISSED', 'SESSION_STARTED',
                           'SESSION_ENDED', 'CONTENT_LOOKUP', 'IDENTIFY'), CAST(event_id % 8 + 1 AS INT)) END
"""
TRAITS_SQL = """
map('age_group', array(element_at(array('18_24', '25_34', '35_44', '55_64', '65_plus'), CAST(user_id % 5 + 1 AS INT))),
    'gender', array(element_at(array('female', 'male', 'Nonbinary', 'Vrouw.'), CAST(user_id % 4 + 1 AS INT))),
    'nationality', array(element_at(array('dutch', 'germany', 'Spain', 'french', 'Poolse', 'new zealand'), CAST(user_id % 6 + 1 AS INT))),
    'province', array(concat('Province-', user_id % 12)),
    'personal_connection', array(element_at(array('yes', 'nee', 'family', 'Ik weet het niet'), CAST(user_id % 4 + 1 AS INT))),
    'email', array(IF(user_id % 3 = 0, 'visitor@example.org', 'nee')))
"""
SURVEY_SQL = """
map('q:interest', array('Eens'), 'interest', array(CAST(event_id % 5 + 1 AS STRING)),
    'boring', array(CAST(event_id div 5 % 5 + 1 AS STRING)), 'relevance', array('past', 'future'),
    'prior_visit', array('once'), 'q:personalization_theme', array(concat('label-', user_id % 10), '17'))
"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as canonical interaction events."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value",
        "CAST(get_json_object(props, '$.k') AS INT) AS k", f"{EVENT_SQL} AS event",
    )
    return base.selectExpr(
        "event_id",
        "CAST(user_id AS STRING) AS user_id",
        "event",
        "ts",
        "IF(event_type <> 'signup', CAST(k AS STRING), NULL) AS content_id",
        "IF(event = 'CONTENT_VIEW_ENDED', value, NULL) AS dwell_seconds",
        "CASE event_type WHEN 'click' THEN 'next_button' WHEN 'purchase' THEN 'link' WHEN 'error' THEN 'abandon' END AS end_reason",
        "IF(event = 'CONTENT_LOOKUP', concat('story ', k), NULL) AS query_text",
        "IF(event_type = 'view', array(CAST((k + 1) % 100 AS STRING), CAST((k + 2) % 100 AS STRING)), "
        "CAST(array() AS ARRAY<STRING>)) AS impressions",
        f"""CASE WHEN event = 'IDENTIFY' THEN {TRAITS_SQL}
                 WHEN event = 'SURVEY_SUBMITTED' THEN {SURVEY_SQL}
                 WHEN event = 'CONTENT_VIEW_ENDED' AND event_id % 10 = 0
                      THEN map('rating', array(CAST(event_id div 10 % 5 + 1 AS STRING)))
                 ELSE CAST(map() AS MAP<STRING, ARRAY<STRING>>) END AS survey_answers""",
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    d = table(spark, sf_dir, "documents").selectExpr("doc_id AS vec_id", "text")
    return v.join(d, "vec_id", "left").selectExpr(
        "CAST(vec_id AS STRING) AS content_id",
        "concat('Item ', vec_id) AS title",
        "text",
        r"IF(text IS NULL, 0, size(split(trim(text), '\\s+'))) AS word_count",
        "vec_id % 3 = 0 AS has_image",
        "52.75D + (vec_id % 100) * 0.0005D AS lat",
        "9.90D + (vec_id div 100) * 0.0005D AS lon",
        "array(CAST(1940 + vec_id % 6 AS INT)) AS years",
    )


TAGS_SQL = """
array_compact(array(
  named_struct('facet', 'theme_what', 'label', concat('label_', label), 'weight', 1.0D),
  named_struct('facet', 'theme_how.type_of_stores', 'label', concat('Store_', vec_id % 4), 'weight', 0.5D),
  IF(vec_id % 5 = 0, named_struct('facet', 'place_where.camp_areas', 'label', concat('AiARLocationBarrack', vec_id % 7), 'weight', 1.0D), NULL),
  IF(vec_id % 6 = 0, named_struct('facet', 'person_who.province_netherlands', 'label', concat('Province-', vec_id % 12), 'weight', 0.7D), NULL)))
"""


def content_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long tag table: content_id, pos, facet, label, weight, key."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    long = v.selectExpr("CAST(vec_id AS STRING) AS content_id", f"posexplode({TAGS_SQL}) AS (pos, t)")
    return long.selectExpr("content_id", "pos", "t.facet", "t.label", "t.weight", "concat(t.facet, ':', t.label) AS key")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").cast("string").alias("content_id"), F.col("embedding").cast("array<double>").alias("vec"))


def provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External demographics of all customers, those without events included."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
    return c.join(n, "c_nationkey").selectExpr(
        "CAST(c_custkey AS STRING) AS user_id",
        "CAST(18 + c_custkey % 60 AS STRING) AS age",
        "IF(c_custkey % 2 = 0, n_name, NULL) AS nationality",
    )


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as served requests (one row per request)."""
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS request_id",
        "CAST(o_custkey AS STRING) AS user_id",
        "CAST(o_orderdate AS TIMESTAMP) AS ts",
        "IF(o_orderstatus = 'P', 'cold', 'warm') AS strategy",
        "o_orderpriority AS priority",
    )


FEATURES_SQL = (
    "array(l_quantity / 50D, l_discount * 10D, l_tax * 12.5D, l_linenumber / 7D, l_extendedprice / 105000D, "
    "(l_suppkey % 10) / 10D)"
)


SERVED_LINE = {
    "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "role": "IF(l_linenumber = 3, 'distractor', 'target')", "features": FEATURES_SQL,
}


def served_items(spark: SparkSession, sf_dir: str, line: dict[str, str] = SERVED_LINE) -> DataFrame:
    """``lineitem`` as served items: one row per (request, item), lowest position wins; ``line`` has the columns beside its order."""
    fields = ", ".join(f"'{name}', {value}" for name, value in line.items())
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS STRING) AS request_id",
        "CAST(l_partkey AS STRING) AS content_id",
        f"named_struct('rank', l_linenumber, 'l_quantity', l_quantity, {fields}) AS line",
    )
    first = rows.groupBy("request_id", "content_id").agg(F.expr("min_by(line, struct(line.rank, line.l_quantity)) AS line"))
    return first.select("request_id", "content_id", "line.*")


def reward_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View-ended events of the served items that were opened."""
    return served_items(spark, sf_dir).filter(F.col("l_linestatus") == "F").selectExpr(
        "request_id", "content_id", "'CONTENT_VIEW_ENDED' AS event", "CAST(rank AS BIGINT) AS event_id",
        "timestamp_seconds(1700000000 + rank) AS ts", "l_quantity * 2 AS dwell_seconds",
        "CASE l_returnflag WHEN 'A' THEN 'next_button' WHEN 'N' THEN 'link' ELSE 'abandon' END AS end_reason",
    )
