"""Temporal replay without leakage: features of each view from the views before it.

All decayed weights of one visitor share the factor 0.5^(now / half life), and every
feature is a ratio, a maximum-normalised sum or a cosine, so that factor cancels. What is
left are running sums of the changes each view makes to its item's signal: the replay is
linear in the views, instead of a refold of the whole history per view. The weights grow as
2^(days / half life), so the sums are decimals: what was added and taken away again cancels
exactly, and an old like still counts when nothing newer is left.
"""

from __future__ import annotations

from math import ceil, log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.config import FEATURES, RecConfig
from recspark.functions import engagement as eng
from recspark.functions.ordered import neighbour, running
from recspark.functions.vectors import cosine
from recspark.operators.held_likes import held_affinity
from recspark.operators.scoring import Catalogue
from recspark.operators.signals import AREA_FACET
from recspark.session import materialize

USER = ["user_id"]
# Views of a block of a visitor's places: most visitors are one block, and what is carried from block to block is small.
PLACES = 256
SPAN = f"IF(ts IS NULL, NULL, place div {PLACES}) AS span"
# Digits of the exact sums, those before the point beside the growth, and the fewest after it.
DIGITS = 37
BEFORE_POINT = 6
AFTER_POINT = 9


def exact_type(views: DataFrame, cfg: RecConfig) -> str:
    """The decimal type that holds the sums of the longest history. Too long a history is an error, not a wrong result."""
    span = views.groupBy("user_id").agg(F.expr("(unix_micros(max(ts)) - unix_micros(min(ts))) / 86400e6D AS days")).agg(F.max("days")).first()[0] or 0.0
    after = DIGITS - BEFORE_POINT - ceil(span / cfg.half_life_days * log10(2))
    if after < AFTER_POINT:
        raise ValueError(f"a history of {span:.0f} days is too long for exact sums with a half life of {cfg.half_life_days} days; replay it in parts")
    return f"DECIMAL({DIGITS}, {min(after, 20)})"


def signal_changes(views: DataFrame, contents: DataFrame, cfg: RecConfig) -> DataFrame:
    """Views with their reward and the item's signals after (pos, neg) and before (pos0, neg0) them, and the change of likes.

    `place` counts a visitor's views from 0, `next_place` is that of the item's next view, and `log_weight` is log2 of
    pos, null if the item is not liked after the view; unlike pos it doesn't overflow, however long the history.

    views: user_id, event_id, content_id, ts, dwell_seconds, end_reason, visits.
    """
    info = contents.selectExpr("content_id", "word_count", "has_image", "true AS known")
    start = views.groupBy("user_id").agg(F.expr("min(ts) AS t0"))
    estimate = eng.reading_time("coalesce(word_count, 0)", "coalesce(has_image, false)", cfg)
    base = views.join(info, "content_id", "left").join(start, "user_id").selectExpr(
        "user_id", "event_id", "content_id", "ts", "dwell_seconds", "end_reason", "visits", "coalesce(known, false) AS known",
        f"{estimate} AS estimate", f"(unix_micros(ts) - unix_micros(t0)) / 86400e6D / {cfg.half_life_days}D AS doublings",
    ).withColumn("growth", F.expr("pow(2D, doublings)"))
    pair = ["user_id", "content_id"]
    state = running(base, pair, "ts", "event_id", {
        "seen": "sum(1)", "longest": "max(dwell_seconds)", "first_us": "max(-unix_micros(ts))",
    }, inclusive=True)
    none = "CAST(NULL AS DOUBLE)"
    span = "(unix_micros(ts) + first_us) / 1e6D"
    known = state.selectExpr(
        "*", f"{eng.strength(f'coalesce(longest, {span})', 'estimate', 'end_reason', 'seen', none, cfg)} AS strength",
        f"{eng.strength('dwell_seconds', 'estimate', 'end_reason', 'visits', none, cfg)} AS reward",
    ).selectExpr("*", f"{eng.outcome('strength', cfg)} AS outcome").selectExpr(
        "user_id", "event_id", "content_id", "ts", "known", "reward",
        "IF(outcome = 'positive', greatest(strength, 0D) * growth, 0D) AS pos",
        "IF(outcome = 'negative', abs(strength) * growth, 0D) AS neg", "IF(outcome = 'positive', 1, 0) AS liked",
        "IF(outcome = 'positive' AND strength > 0, log2(strength) + doublings, NULL) AS log_weight",
    )
    placed = running(known, USER, "ts", "event_id", {"views_before": "sum(1)"}).withColumn("place", F.expr("coalesce(views_before, 0L)")).drop("views_before")
    lagged = neighbour(placed, pair, "ts", "event_id", F.struct("pos", "neg", "liked"), "before")
    both = neighbour(lagged, pair, "ts", "event_id", F.col("place"), "next_place", forward=True)
    return both.selectExpr(
        "user_id", "event_id", "content_id", "ts", "known", "reward", "pos", "coalesce(before.pos, 0D) AS pos0",
        "neg", "coalesce(before.neg, 0D) AS neg0", "liked - coalesce(before.liked, 0) AS dlikes", "place", "next_place", "log_weight",
    )


def _change(after: str, before: str, factor: str, exact: str) -> str:
    """SQL: exact sum of the changes of a weighted signal."""
    return f"sum(CAST({after} * {factor} AS {exact}) - CAST({before} * {factor} AS {exact}))"


def tag_features(changes: DataFrame, catalogue: Catalogue, exact: str) -> DataFrame:
    """(user_id, event_id, tag, aversion) from the running key sums before each view."""
    summed = catalogue.keyed_tags.filter(f"facet <> '{AREA_FACET}'").groupBy("content_id", "nkey").agg(F.expr("sum(weight) AS w_sum"))
    keyed = summed.join(catalogue.tags_nkey.selectExpr("content_id", "nkey", "weight AS w_last"), ["content_id", "nkey"])
    rows = changes.join(keyed, "content_id").select("user_id", "event_id", "ts", F.expr(SPAN), "nkey", "w_sum", "w_last", "pos", "pos0", "neg", "neg0")
    held = running(rows, ["user_id", "nkey"], "ts", "event_id", {"likes": _change("pos", "pos0", "w_sum", exact), "dislikes": _change("neg", "neg0", "w_sum", exact)}, block="span")
    matched = held.groupBy("user_id", "event_id").agg(
        F.expr("sum(CAST(likes AS DOUBLE) * w_last) AS likes"), F.expr("sum(CAST(dislikes AS DOUBLE) * w_last) AS dislikes")
    )
    mass = summed.groupBy("content_id").agg(F.expr("sum(w_sum) AS mass"))
    totals = running(
        changes.join(mass, "content_id", "left").selectExpr("user_id", "event_id", "ts", SPAN, "coalesce(mass, 0D) AS mass", "pos", "pos0", "neg", "neg0"),
        USER, "ts", "event_id", {"all_likes": _change("pos", "pos0", "mass", exact), "all_dislikes": _change("neg", "neg0", "mass", exact)}, block="span",
    )

    def share(part: str, whole: str, name: str) -> str:
        return f"IF({whole} > 0, greatest(0D, least(coalesce({part}, 0D) / CAST({whole} AS DOUBLE), 1D)), 0D) AS {name}"

    return totals.join(matched, ["user_id", "event_id"], "left").selectExpr(
        "user_id", "event_id", share("likes", "all_likes", "tag"), share("dislikes", "all_dislikes", "aversion")
    )


def vector_features(changes: DataFrame, catalogue: Catalogue, exact: str) -> DataFrame:
    """(user_id, event_id, semantic, recency): taste is a running vector sum, recency the view before."""
    d = catalogue.dim
    zero = f"array_repeat(0D, {d})"
    held = changes.join(catalogue.vectors.select("content_id", "vec"), "content_id", "left").selectExpr(
        "user_id", "event_id", "ts", SPAN, "vec", "pos", "pos0", "IF(vec IS NULL, 0, dlikes) AS dlikes"
    )
    sums = {f"s{i}": _change("pos", "pos0", f"coalesce(vec, {zero})[{i}]", exact) for i in range(d)}
    taste = running(held, USER, "ts", "event_id", {**sums, "likes": "sum(dlikes)"}, block="span")
    taste = taste.selectExpr("user_id", "event_id", "ts", "span", "vec", "likes", "array(" + ", ".join(f"CAST(s{i} AS DOUBLE)" for i in range(d)) + ") AS taste")
    last = neighbour(taste, USER, "ts", "event_id", F.col("vec"), "prev_vec", block="span")
    return last.selectExpr(
        "user_id", "event_id", f"IF(likes > 0 AND vec IS NOT NULL, ({cosine('taste', 'vec')} + 1D) / 2D, 0D) AS semantic",
        f"IF(prev_vec IS NOT NULL AND vec IS NOT NULL, ({cosine('prev_vec', 'vec')} + 1D) / 2D, 0D) AS recency",
    )


def replay_samples(views: DataFrame, catalogue: Catalogue, cfg: RecConfig) -> DataFrame:
    """(user_id, event_id, content_id, semantic, affinity, tag, recency, aversion, geo, features, reward) per view of a known item.

    `features` are the scores in the order of FEATURES, as for served lists; a replayed view has no place, so geo is 0.
    """
    exact = exact_type(views, cfg)
    changes = materialize(signal_changes(views, catalogue.contents, cfg))
    key = ["user_id", "event_id"]
    rows = changes.filter("known").select("user_id", "event_id", "content_id", "reward")
    held = held_affinity(changes.select(*key, "content_id", "place", "next_place", "log_weight"), catalogue.vectors, catalogue.dim)
    scored = rows.join(tag_features(changes, catalogue, exact), key).join(vector_features(changes, catalogue, exact), key).join(held, key, "left")
    return scored.withColumns({"affinity": F.expr("coalesce(affinity, 0D)"), "geo": F.lit(0.0)}).selectExpr(
        *key, "content_id", *FEATURES, f"array({', '.join(FEATURES)}) AS features", "reward")
