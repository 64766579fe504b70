"""Visitor extras beside the persona: strongest keys, liked contents, readable answers, counts, and the event timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.ordered import top_k

TOP_KEYS = 12
TOP_LIKED = 15
TIMELINE_ROWS = 200


def strongest_keys(weights: DataFrame, n: int = TOP_KEYS) -> DataFrame:
    """(user_id, rank, key, weight): each visitor's n keys of largest absolute weight (ties by key)."""
    order = [F.expr("abs(weight)").desc(), F.col("key")]
    return top_k(weights.select("user_id", "key", "weight"), ["user_id"], order, n, rank="rank")


def liked_contents(positives: DataFrame, contents: DataFrame, content_tags: DataFrame, n: int = TOP_LIKED) -> DataFrame:
    """(user_id, rank, content_id, weight, title, tags): the n most liked items (ties by id) with why they may be liked.

    The cut comes first, so titles and tags are joined to n rows per visitor only.
    """
    best = top_k(positives.select("user_id", "content_id", "weight"), ["user_id"], [F.desc("weight"), F.col("content_id")], n, rank="rank")
    tags = content_tags.groupBy("content_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, key))), t -> t.key) AS tags"))
    return best.join(contents.select("content_id", "title"), "content_id", "left").join(tags, "content_id", "left").selectExpr(
        "user_id", "rank", "content_id", "weight", "title", "coalesce(tags, array()) AS tags")


def readable_answers(split: DataFrame, contents: DataFrame) -> DataFrame:
    """(user_id, base, answer): personalisation answers in words.

    Answers of an interest question that are all numbers are content ids and become titles. Others lose the location
    prefix, get a blank before a capital or digit that follows a small letter, and become title case if they hold an
    underscore or no capital.
    """
    rows = split.filter("section = 'personalization'").selectExpr(
        "user_id", "base", "endswith(base, 'interest') AND forall(answer, v -> v RLIKE '^[0-9]+$') AS ids", "posexplode(answer) AS (pos, v)")
    titled = rows.join(contents.selectExpr("content_id AS v", "title"), "v", "left")
    bare = "regexp_replace(v, '^AiARLocation', '')"
    spaced = f"regexp_replace({bare}, '(?<=[a-z])(?=[A-Z0-9])', ' ')"
    plain = f"IF(contains({spaced}, '_') OR ({spaced} = lower({spaced}) AND {spaced} RLIKE '[a-z]'), initcap(trim(replace({spaced}, '_', ' '))), {spaced})"
    shown = titled.selectExpr("user_id", "base", "pos", f"IF(ids, coalesce(title, v), {plain}) AS shown")
    return shown.groupBy("user_id", "base").agg(F.expr("transform(array_sort(collect_list(struct(pos, shown))), x -> x.shown) AS answer"))


def visitor_counts(users: DataFrame, split: DataFrame, signals: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row per visitor: answered questions, completed surveys, sizes of the model, cold or not."""
    answered = split.groupBy("user_id").agg(
        F.expr("count(*) AS answers"), F.expr("bool_or(section = 'demographic') AS demographic"), F.expr("bool_or(section = 'personalization') AS personalization"))
    sizes = [t.groupBy("user_id").agg(F.expr(f"count(*) AS {n}")) for n, t in (("viewed", signals), ("positives", positives), ("negatives", negatives))]
    out = users.select("user_id").distinct().join(answered, "user_id", "left")
    for size in sizes:
        out = out.join(size, "user_id", "left")
    return out.selectExpr(
        "user_id", "coalesce(answers, 0) AS answers", "coalesce(demographic, false) AS completed_demographic", "coalesce(personalization, false) AS completed_personalization",
        *[f"coalesce({n}, 0) AS {n}" for n in ("viewed", "positives", "negatives")], "coalesce(viewed, 0) = 0 AS is_cold")


def event_timeline(events: DataFrame, contents: DataFrame, n: int = TIMELINE_ROWS) -> DataFrame:
    """Each visitor's n newest events, newest first, with title; ``events`` may carry the ``meta`` of `event_metadata`."""
    kept = [c for c in ("event_id", "user_id", "ts", "event", "content_id", "dwell_seconds", "end_reason", "request_id", "session_id", "meta") if c in events.columns]
    newest = top_k(events.select(*kept), ["user_id"], [F.desc("ts"), F.desc("event_id")], n, rank="place")
    return newest.join(contents.select("content_id", "title"), "content_id", "left").withColumn("title", F.expr("coalesce(title, '')"))
