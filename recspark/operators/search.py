"""Vector, geo, hybrid, preference and profile search over a table of queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.config import RecConfig
from recspark.functions.engagement import reading_time
from recspark.functions.ordered import top_k
from recspark.functions.text_vectors import text_vectors
from recspark.functions.vectors import cosine
from recspark.operators.candidates import in_radius
from recspark.operators.knn import nearest
from recspark.operators.signals import vector_dim

LIMIT = 5  # fixed value: hits per search


def route(queries: DataFrame) -> DataFrame:
    """Adds ``search_type`` by the inputs present; null marks a query with none (a reject)."""
    text, geo = "trim(coalesce(text, '')) <> ''", "(lat IS NOT NULL AND lon IS NOT NULL)"
    return queries.selectExpr(
        "*", f"CASE WHEN {text} AND {geo} THEN 'hybrid' WHEN {text} THEN 'vector' WHEN {geo} THEN 'geo' END AS search_type"
    )


def search(queries: DataFrame, contents: DataFrame, vectors: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(query_id, search_type, content_id, score, rank) of queries (query_id, text, lat, lon, radius_m)."""
    routed = route(queries)
    texts = routed.filter("search_type IN ('vector', 'hybrid')").selectExpr("query_id AS id", "text")
    qvec = text_vectors(texts, vector_dim(vectors)).selectExpr("id AS query_id", "vec AS qvec")
    plain = routed.filter("search_type = 'vector'").select("query_id").join(qvec, "query_id")
    by_vector = nearest(plain.selectExpr("query_id AS qid", "qvec"), vectors, limit).selectExpr(
        "qid AS query_id", "'vector' AS search_type", "content_id", "score", "rank")
    located = routed.filter("search_type IN ('geo', 'hybrid')").selectExpr("query_id", "search_type", "lat", "lon", "coalesce(radius_m, 5000D) AS radius_m")
    near = in_radius(located, contents.select("content_id", "lat", "lon"))
    by_place = top_k(near.filter("search_type = 'geo'"), ["query_id"], [F.col("distance_m"), F.col("content_id")], limit, rank="rank").selectExpr(
        "query_id", "search_type", "content_id", "CAST(NULL AS DOUBLE) AS score", "rank")
    both = near.filter("search_type = 'hybrid'").join(qvec, "query_id").join(vectors, "content_id").selectExpr(
        "query_id", "search_type", "content_id", f"{cosine('qvec', 'vec')} AS score")
    hybrid = top_k(both, ["query_id"], [F.desc("score"), F.col("content_id")], limit, rank="rank")
    return by_vector.unionByName(by_place).unionByName(hybrid)


def projection(pairs: DataFrame, contents: DataFrame, cfg: RecConfig) -> DataFrame:
    """Paired views with the reading estimate and whether the visitor stayed that long."""
    known = pairs.join(contents.selectExpr("content_id AS item_id", "word_count", "has_image"), "item_id")
    return known.selectExpr(
        "user_id", "item_id", "start_ts", "close_ts", "dwell_seconds", f"{reading_time('word_count', 'has_image', cfg)} AS estimated_reading_time"
    ).selectExpr("*", "dwell_seconds >= estimated_reading_time AS is_successful")


def preference_search(projected: DataFrame, vectors: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(user_id, content_id, score, rank): near 2 avg(liked) - avg(left early), examples left out.

    Visitors without a successful view get nothing.
    """
    rows = projected.join(vectors.filter("vec IS NOT NULL").selectExpr("content_id AS item_id", "vec"), "item_id").withColumn("liked", F.expr("coalesce(is_successful, false)"))

    def mean(which: str, name: str) -> DataFrame:
        return rows.filter(which).groupBy("user_id").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias(name))

    means = mean("liked", "good").join(mean("NOT liked", "bad"), "user_id", "left")
    examples = projected.selectExpr("user_id", "item_id AS content_id").distinct()
    counts = examples.groupBy("user_id").agg(F.expr("CAST(count(*) AS INT) AS extra"))
    asked = means.join(counts, "user_id").selectExpr("user_id AS qid", "IF(bad IS NULL, good, zip_with(good, bad, (x, y) -> 2D * x - y)) AS qvec", "extra")
    hits = nearest(asked, vectors, limit).selectExpr("qid AS user_id", "content_id", "score")
    fresh = hits.join(examples, ["user_id", "content_id"], "left_anti")
    return top_k(fresh, ["user_id"], [F.desc("score"), F.col("content_id")], limit, rank="rank")


def profile_text(people: DataFrame) -> DataFrame:
    """(user_id, text): one sentence per visitor from age, gender and nationality."""
    return people.selectExpr(
        "user_id",
        "concat(age, '-year-old ', gender, ' from ', nationality, ', interested in content related to people from the same nationality and similar age.') AS text",
    )


def limit_text(text: str, limit: int = 80) -> str:
    return f"IF(length({text}) > {limit}, concat(substring({text}, 1, {limit}), '...'), {text})"


def highlight(text: str, needle: str, before: str = "<b>", after: str = "</b>") -> str:
    """Case-insensitive mark at word starts; the needle is taken literally."""
    quoted = rf"regexp_replace({needle}, '([^\\p{{L}}\\p{{N}} ])', '\\\\$1')"
    return f"regexp_replace({text}, concat('(?i)\\\\b(', {quoted}, ')'), '{before}$1{after}')"
