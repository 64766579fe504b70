"""Evidence-backed visitor personas: interests, style, preference, type, trajectory, prose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.ordered import neighbour, top_k

# Facet families, hints, connection answers and wording.
INTROSPECTIVE_HINTS = "personal stories|personal story|testimony"
CLOSE_CONNECTIONS = "'yes', 'family', 'descendant', 'survivor'"
SOCIAL_CONNECTIONS = "'family', 'group', 'with_family', 'social'"
STYLE_TEXT = {
    "deep_reader": "reads stories closely, finishing what they start",
    "completionist": "works through many stories to completion",
    "skimmer": "skims widely, sampling many stories briefly",
    "sampler": "samples a range of stories at a moderate pace",
    "contemplative": "lingers on a few stories, reading slowly and reflectively",
    "unknown": "has not yet shown a clear reading style",
}
RATIONALE = {
    "Hobbyist": "narrow, deep, repeat engagement with specific themes",
    "Explorer": "broad curiosity across themes with real engagement",
    "Experience-Seeker": "broad but light, skims many without finishing",
    "Recharger": "lingers on a few introspective stories, slow pace",
    "Facilitator": "signals of a social/accompanied visit",
}
COLD_TEXT = (
    "New visitor, no engagement yet. Recommendations start from any survey persona or demographics, then adapt as they read."
)


def entropy_sql(weight: str) -> str:
    """Aggregate: Shannon entropy of the positive weights, scaled to [0, 1] by its maximum."""
    w = f"IF({weight} > 0, {weight}, NULL)"
    return f"IF(count({w}) > 1, (ln(sum({w})) - sum({w} * ln({w})) / sum({w})) / ln(count({w})), 0D)"


def dominant_themes(tags: DataFrame) -> DataFrame:
    """(content_id, theme): the heaviest ``theme_what`` label of each item."""
    return tags.filter("facet = 'theme_what'").groupBy("content_id").agg(
        F.expr("max_by(label, struct(weight, -pos)) AS theme")
    )


def theme_breadth(signals: DataFrame, affinity: DataFrame, tags: DataFrame) -> DataFrame:
    """(user_id, breadth): distinct themes of liked (else viewed) items; affinity entropy
    where no theme is known."""
    per_item = signals.join(dominant_themes(tags), "content_id", "left").groupBy("user_id").agg(
        F.expr("count_if(outcome = 'positive') AS liked"),
        F.expr("count(DISTINCT IF(outcome = 'positive', theme, NULL)) AS liked_themes"),
        F.expr("count(DISTINCT theme) AS viewed_themes"),
    ).selectExpr("user_id", "IF(liked > 0, liked_themes, viewed_themes) AS themes")
    theme = "IF(startswith(key, 'theme_what'), weight, NULL)"
    spread = affinity.groupBy("user_id").agg(
        F.expr(f"IF(count({theme}) > 0, {entropy_sql(theme)}, {entropy_sql('weight')}) AS entropy")
    )
    return per_item.join(spread, "user_id", "full_outer").selectExpr(
        "user_id", "IF(themes > 0, least(greatest((themes - 1) / 3D, 0D), 1D), coalesce(entropy, 0D)) AS breadth"
    )


def interests(weights: DataFrame, items: DataFrame, tags: DataFrame, top: int = 5, evidence: int = 5) -> DataFrame:
    """(user_id, rank, facet, label, weight, evidence): strongest keys with the items behind them."""
    best = top_k(weights.select("user_id", "key", "weight"), ["user_id"], [F.expr("round(weight, 9)").desc(), F.col("key")], top, rank="rank")
    keys = tags.selectExpr("content_id", "lower(key) AS key").distinct()
    # From the visitor's items to their keys: a key alone leads to every item that carries it.
    proof = items.selectExpr("user_id", "content_id", "weight AS item_weight").join(keys, "content_id").join(
        best.select("user_id", "key"), ["user_id", "key"]
    )
    proof = top_k(proof, ["user_id", "key"], [F.expr("round(item_weight, 9)").desc(), F.col("content_id")], evidence, rank="at")
    lists = proof.groupBy("user_id", "key").agg(F.expr("transform(array_sort(collect_list(struct(at, content_id))), x -> x.content_id) AS evidence"))
    return best.join(lists, ["user_id", "key"], "left").selectExpr(
        "user_id", "rank", "substring_index(key, ':', 1) AS facet", "regexp_replace(key, '^[^:]*:', '') AS label", "weight",
        "coalesce(evidence, CAST(array() AS ARRAY<STRING>)) AS evidence",
    )


def trajectory(views: DataFrame, tags: DataFrame, top: int = 6) -> DataFrame:
    """(user_id, rank, theme): themes of the recent views, newest first, repeats collapsed."""
    themed = views.select("user_id", "content_id", "last_ts").join(dominant_themes(tags), "content_id")
    newer = neighbour(themed, ["user_id"], "last_ts", "content_id", F.col("theme"), "newer_theme", forward=True)
    steps = newer.filter("newer_theme IS NULL OR newer_theme <> theme")
    return top_k(steps, ["user_id"], [F.desc("last_ts"), F.desc("content_id")], top, rank="rank").select("user_id", "rank", "theme")


def _style() -> str:
    return (
        "CASE WHEN n_views = 0 THEN 'unknown' WHEN dwell >= 0.6 AND completion >= 0.5 THEN 'deep_reader' "
        "WHEN dwell >= 0.7 AND n_views <= 3 AND breadth < 0.5 THEN 'contemplative' "
        "WHEN completion >= 0.7 AND n_views >= 4 THEN 'completionist' WHEN dwell < 0.35 AND n_views >= 4 THEN 'skimmer' ELSE 'sampler' END"
    )


def personas(model, tags: DataFrame) -> DataFrame:
    """One row per visitor with an event: style, preference, visitor type and its scores."""
    label = "regexp_replace(key, '^[^:]*:', '')"
    hint = f"startswith(key, 'theme_how') AND {label} RLIKE '{INTROSPECTIVE_HINTS}'"
    family = model.tag_affinity.groupBy("user_id").agg(
        F.expr("sum(weight) AS total"),
        F.expr("sum(IF(startswith(key, 'person_who'), weight, 0D)) AS person"),
        F.expr("sum(IF(startswith(key, 'theme_what'), weight, 0D)) AS what"),
        F.expr(f"sum(CASE WHEN {hint} THEN weight WHEN startswith(key, 'person_who') THEN 0.5D * weight ELSE 0D END) AS introspective"),
        F.expr("sum(IF(startswith(key, 'medium_what'), weight, 0D)) AS object"),
        F.expr(f"sum(IF(NOT ({hint}) AND (startswith(key, 'theme_what') OR startswith(key, 'time_when') OR startswith(key, 'place_where')), weight, 0D)) AS cognitive"),
    )
    base = (
        model.events.select("user_id").distinct()
        .join(model.behavior, "user_id", "left")
        .join(family, "user_id", "left")
        .join(theme_breadth(model.signals, model.tag_affinity, tags), "user_id", "left")
        .join(model.demographics.selectExpr("user_id", "lower(coalesce(personal_connection, '')) AS pc"), "user_id", "left")
        .selectExpr(
            "user_id", "coalesce(n_views, 0) AS n_views", "coalesce(n_positive, 0) AS n_positive", "coalesce(n_negative, 0) AS n_negative",
            "round(coalesce(avg_dwell_ratio, 0D), 4) AS dwell", "round(coalesce(completion_rate, 0D), 4) AS completion",
            "round(coalesce(depth, 0D), 4) AS liked_share", "coalesce(breadth, 0D) AS breadth",
            "coalesce(try_divide(person, total), 0D) AS introspective_share", "coalesce(try_divide(what, total), 0D) AS cognitive_share",
            "coalesce(object, 0D) AS object", "coalesce(cognitive, 0D) AS cognitive",
            f"coalesce(introspective, 0D) + IF(pc IN ({CLOSE_CONNECTIONS}), 0.5D, 0D) AS introspective",
            f"IF(pc IN ({SOCIAL_CONNECTIONS}), 0.6D, 0D) AS social_hint", "total IS NOT NULL AS warm",
        )
        .selectExpr(
            "*", "greatest(dwell, liked_share, IF(warm, 0.35D, 0D)) AS reach",
            "greatest(0D, 1D - greatest(n_views - 1, 0) / 6D) AS few", "IF(n_views > 0, least(n_views / 5D, 1D), 0.4D) AS many",
        )
    )
    scores = (
        "array(struct(-((1D - breadth) * reach * (0.4D + 0.6D * cognitive_share) * (0.4D + 0.6D * many)) AS s, 1 AS o, 'Hobbyist' AS t), "
        "struct(-(breadth * reach) AS s, 2 AS o, 'Explorer' AS t), "
        "struct(-(breadth * (1D - least(dwell, completion)) * (0.4D + 0.6D * many)) AS s, 3 AS o, 'Experience-Seeker' AS t), "
        "struct(-(reach * (1D - breadth) * few * (0.4D + 0.6D * introspective_share)) AS s, 4 AS o, 'Recharger' AS t), "
        "struct(-social_hint AS s, 5 AS o, 'Facilitator' AS t))"
    )
    preference = (
        "CASE WHEN greatest(object, cognitive, introspective) = 0 THEN 'unknown' WHEN object >= greatest(cognitive, introspective) THEN 'object' "
        "WHEN cognitive >= introspective THEN 'cognitive' ELSE 'introspective' END"
    )
    rationale = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in RATIONALE.items()) + ")"
    return base.selectExpr("*", f"array_sort({scores}) AS ranked").selectExpr(
        "user_id", "n_views", "n_positive", "n_negative", "dwell", "completion", "breadth", "n_positive = 0 AS is_cold",
        f"{_style()} AS engagement_style", f"{preference} AS experience_preference", "ranked[0].t AS visitor_type",
        "greatest(ranked[1].s - ranked[0].s, 0D) AS confidence", f"{rationale}[ranked[0].t] AS rationale",
        "map_from_entries(transform(ranked, r -> struct(r.t, -r.s))) AS scores",
    )


def verbalize(people: DataFrame, liked: DataFrame, disliked: DataFrame, path: DataFrame) -> DataFrame:
    """(user_id, summary): one template paragraph per visitor from the persona tables."""
    pull = liked.filter("rank <= 3").groupBy("user_id").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(rank, concat(label, IF(size(evidence) > 0, concat(' (', size(evidence), ')'), '')) AS t))), x -> x.t), ', ') AS pull"))
    avoid = disliked.filter("rank <= 2").groupBy("user_id").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(rank, label AS t))), x -> x.t), ', ') AS avoid"))
    walk = path.groupBy("user_id").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(rank, theme AS t))), x -> x.t), ' → ') AS walk"))
    style = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in STYLE_TEXT.items()) + ")[engagement_style]"
    counts = (
        "concat('Engaged with ', n_views, IF(n_views = 1, ' story', ' stories'), "
        "IF(n_positive + n_negative > 0, concat(': ', concat_ws(', ', IF(n_positive > 0, concat(n_positive, ' held attention'), NULL), "
        "IF(n_negative > 0, concat(n_negative, ' dismissed'), NULL))), ''), '.')"
    )
    reading = "concat('Reads to about ', CAST(bround(dwell * 100) AS INT), '% of the estimated time, finishing ', CAST(bround(completion * 100) AS INT), '%.')"
    kind = (
        f"concat(upper(substring({style}, 1, 1)), substring({style}, 2), '; reads like ', "
        "IF(lower(substring(visitor_type, 1, 1)) IN ('a', 'e', 'i', 'o', 'u'), 'an ', 'a '), lower(visitor_type), '.')"
    )
    text = (
        f"concat_ws(' ', IF(n_views > 0, {counts}, NULL), IF(n_views > 0, {reading}, NULL), "
        "IF(pull IS NULL, NULL, concat('Strongest pull toward ', pull, '.')), IF(avoid IS NULL, NULL, concat('Tends to avoid ', avoid, '.')), "
        f"IF(walk IS NULL, NULL, concat('Recent path: ', walk, '.')), {kind})"
    )
    joined = people.join(pull, "user_id", "left").join(avoid, "user_id", "left").join(walk, "user_id", "left")
    return joined.selectExpr("user_id", f"IF(coalesce(pull, avoid, walk) IS NULL, '{COLD_TEXT}', {text}) AS summary")


def explain_served(items: DataFrame, tags_nkey: DataFrame, affinity: DataFrame) -> DataFrame:
    """(request_id, content_id, nkey, user_weight): what a served item and the visitor share."""
    held = affinity.groupBy("user_id", "nkey").agg(F.expr("max(weight) AS user_weight"))
    return items.select("request_id", "user_id", "content_id").join(tags_nkey.select("content_id", "nkey"), "content_id").join(
        held, ["user_id", "nkey"]
    ).select("request_id", "content_id", "nkey", "user_weight")
