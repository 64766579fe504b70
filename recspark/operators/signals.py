"""The visitor model: interaction events + catalogue -> per-visitor signals.

Everything is a long table keyed by ``user_id``; nothing gathers a visitor's history in
one row. All per-visitor sums have map-side partial aggregation, so a visitor (or item)
that holds a large share of the events does not overload one task.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.config import RecConfig
from recspark.functions import engagement as eng
from recspark.functions import survey as sv
from recspark.functions.labels import with_nkey
from recspark.functions.ordered import top_k
from recspark.functions.vectors import summed, unit, vector_sums
from recspark.session import materialize

VIEW_START = "CONTENT_VIEW_STARTED"
VIEW_END = "CONTENT_VIEW_ENDED"
# Fixed value: proximity tags never count as taste.
AREA_FACET = "place_where.camp_areas"


def aggregate_views(events: DataFrame) -> DataFrame:
    """One row per (user, content) with visits, dwell, end reason, last time and rating."""
    start, end = f"event = '{VIEW_START}'", f"event = '{VIEW_END}'"
    order = "struct(ts, event_id)"
    span = f"(unix_micros(max(IF({end}, ts, NULL))) - unix_micros(min(IF({start}, ts, NULL)))) / 1e6D"
    rating = "survey_answers['rating']"
    return events.filter("content_id IS NOT NULL").groupBy("user_id", "content_id").agg(
        F.expr(f"greatest(count_if({start}), 1) AS visits"),
        F.expr(f"coalesce(max(dwell_seconds), greatest({span}, 0D)) AS dwell_seconds"),
        F.expr(f"max_by(end_reason, IF({end}, {order}, NULL)) AS end_reason"),
        F.expr("max(ts) AS last_ts"),
        F.expr(f"max_by(try_cast(get({rating}, 0) AS DOUBLE), IF({rating} IS NOT NULL, {order}, NULL)) AS survey_rating"),
    )


def score_views(views: DataFrame, contents: DataFrame, now: datetime, cfg: RecConfig) -> DataFrame:
    """Engagement strength, outcome, decay and dwell ratio per (user, content).

    An unknown content has estimate 0, so any dwell on it counts as fully read.
    """
    known = views.join(contents.select("content_id", "word_count", "has_image"), "content_id", "left")
    estimate = eng.reading_time("coalesce(word_count, 0)", "coalesce(has_image, false)", cfg)
    kept = ("user_id", "content_id", "visits", "dwell_seconds", "end_reason", "last_ts", "survey_rating")
    scored = known.selectExpr(*kept, f"{estimate} AS estimate").selectExpr(
        "*",
        f"{eng.strength('dwell_seconds', 'estimate', 'end_reason', 'visits', 'survey_rating', cfg)} AS strength",
        f"{eng.dwell_ratio('dwell_seconds', 'estimate', cfg)} AS dwell_ratio",
        f"{eng.decay('last_ts', now, cfg)} AS decay",
    )
    return scored.selectExpr("*", f"{eng.outcome('strength', cfg)} AS outcome")


def item_signals(scored: DataFrame) -> DataFrame:
    """Scored views with the decayed signal weight (null for neutral items)."""
    return scored.selectExpr(
        "*",
        "CASE outcome WHEN 'positive' THEN greatest(strength, 0D) * decay "
        "WHEN 'negative' THEN abs(strength) * decay END AS weight",
    )


def positives(signals: DataFrame) -> DataFrame:
    return signals.filter("outcome = 'positive'").select("user_id", "content_id", "weight", "last_ts")


def shown_items(events: DataFrame) -> DataFrame:
    """(user_id, content_id, ts): the latest time each item was in an impression set."""
    return (
        events.filter("size(impressions) > 0")
        .selectExpr("user_id", "ts", "explode(impressions) AS content_id")
        .groupBy("user_id", "content_id")
        .agg(F.expr("max(ts) AS ts"))
    )


def soft_negatives(shown: DataFrame, views: DataFrame, now: datetime, cfg: RecConfig) -> DataFrame:
    """Items shown in an impression set and never engaged: the freshest showing counts."""
    unseen = shown.join(views.select("user_id", "content_id"), ["user_id", "content_id"], "left_anti")
    return unseen.selectExpr("user_id", "content_id", f"{cfg.soft_negative_weight}D * {eng.decay('ts', now, cfg)} AS weight")


def negatives(explicit: DataFrame, soft: DataFrame) -> DataFrame:
    return explicit.unionByName(soft).groupBy("user_id", "content_id").agg(F.expr("max(weight) AS weight"))


def item_tag_weights(items: DataFrame, content_tags: DataFrame) -> DataFrame:
    """(user, key, amount) rows: item weight x tag weight, without proximity tags."""
    tags = content_tags.filter(f"facet <> '{AREA_FACET}'").selectExpr("content_id", "key", "weight AS tag_weight")
    return items.join(tags, "content_id").selectExpr("user_id", "key", "weight * tag_weight AS amount")


def fold_keys(amounts: DataFrame) -> DataFrame:
    """(user_id, key, weight, nkey): case variants of a key merge, each user's largest value
    becomes 1, and the canonical key is kept beside the folded one."""
    folded = amounts.groupBy("user_id", F.expr("lower(key) AS key")).agg(F.expr("sum(amount) AS total"))
    scaled = folded.selectExpr("user_id", "key", "total", "max(total) OVER (PARTITION BY user_id) AS top").selectExpr(
        "user_id", "key", "IF(top > 0, total / top, total) AS weight"
    )
    return with_nkey(scaled)


def survey_events(events: DataFrame) -> DataFrame:
    return events.filter(f"event IN ({sv.sql_list(sv.DEMOGRAPHIC_EVENTS)}) AND size(survey_answers) > 0")


def survey_tag_weights(events: DataFrame) -> DataFrame:
    """Tags given by survey and identify answers; repeated events add up."""
    return survey_events(events).selectExpr(
        "user_id", f"inline({sv.survey_affinity('survey_answers')}) AS (key, amount)"
    )


def answered_demographics(events: DataFrame) -> DataFrame:
    """Latest answer per field."""
    answered = survey_events(events).selectExpr(
        "user_id", "struct(ts, event_id) AS at", f"{sv.demographics_of('survey_answers')} AS d"
    )
    return answered.groupBy("user_id").agg(
        *[F.expr(f"max_by(d.{f}, IF(d.{f} IS NOT NULL, at, NULL)) AS {f}") for f in sv.DEMO_FIELDS]
    )


def demographics(out: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """Latest answer per field; values of the external provider override them."""
    if provider is None:
        return out
    given = [f for f in sv.DEMO_FIELDS if f in provider.columns]
    p = provider.selectExpr("user_id", *[f"{f} AS p_{f}" for f in given])
    merged = [f"coalesce(p_{f}, {f}) AS {f}" if f in given else f for f in sv.DEMO_FIELDS]
    return out.join(p, "user_id", "full_outer").selectExpr("user_id", *merged)


def demographic_tag_weights(demo: DataFrame) -> DataFrame:
    entries = sv.demographic_affinity("age", "gender", "nationality", "province")
    return demo.selectExpr("user_id", f"inline({entries}) AS (key, amount)")


def vector_dim(vectors: DataFrame, column: str = "vec") -> int:
    """The one length of all vectors, 0 without any. Vectors of different lengths are an error, and none is cut or filled."""
    sizes = vectors.filter(f"{column} IS NOT NULL").groupBy(F.expr(f"size({column})").alias("n")).agg(F.expr("count(*) AS rows")).orderBy(F.desc("rows")).limit(3).collect()
    if len(sizes) > 1:
        raise ValueError("vectors of different lengths: " + ", ".join(f"{r['rows']} of {r['n']}" for r in sizes))
    return int(sizes[0]["n"]) if sizes else 0


def weighted_centroid(items: DataFrame, vectors: DataFrame, keys: list[str], weight: str, out: str) -> DataFrame:
    """Normalised weighted vector sum per key; keys whose sum is all zero are dropped.

    One sum a component, combined in each map task; vectors of different lengths stop the job if they are summed. The items
    of a key are brought to one task first, narrow as they are, so that few partial sums a key are sent. By a hash that
    the sums are not grouped by, a task with too many rows can be split: one key may hold a large share of them.
    """
    have = vectors.filter("vec IS NOT NULL")
    try:
        dim = vector_dim(have)
    except ValueError:
        have = have.join(items.select("content_id"), "content_id", "left_semi")
        dim = vector_dim(have)
    near = items.select(*keys, "content_id", F.expr(weight).alias("_w"), F.xxhash64(*keys).alias("_near")).hint("rebalance", "_near").drop("_near")
    joined = near.join(have.select("content_id", F.col("vec").alias("_v")), "content_id")
    packed = joined.groupBy(*keys).agg(*vector_sums("_v", dim, "_w")).selectExpr(*keys, f"{summed(dim)} AS _sum")
    return packed.filter("exists(_sum, x -> x <> 0)").selectExpr(*keys, f"{unit('_sum')} AS {out}")


def latest_view(views: DataFrame) -> DataFrame:
    """Most recent item of each visitor (ties: lowest content id)."""
    return views.groupBy("user_id").agg(
        F.expr("min_by(content_id, struct(-unix_micros(last_ts), content_id)) AS content_id")
    )


def behavior(scored: DataFrame, neg: DataFrame) -> DataFrame:
    """Engagement summary per visitor. Visitors without views but with soft negatives count."""
    seen = scored.groupBy("user_id").agg(
        F.expr("count(*) AS n_views"),
        F.expr("count_if(outcome = 'positive') AS n_positive"),
        F.expr("avg(dwell_ratio) AS avg_dwell_ratio"),
        F.expr("avg(IF(end_reason = 'next_button', 1D, 0D)) AS completion_rate"),
        F.expr("avg(IF(visits > 1, 1D, 0D)) AS revisit_rate"),
        F.expr("avg(IF(outcome = 'positive', 1D, 0D)) AS depth"),
    )
    disliked = neg.groupBy("user_id").agg(F.expr("count(*) AS n_negative"))
    counts = [f"coalesce({c}, 0) AS {c}" for c in ("n_views", "n_positive", "n_negative")]
    rates = [f"coalesce({c}, 0D) AS {c}" for c in ("avg_dwell_ratio", "completion_rate", "revisit_rate", "depth")]
    return seen.join(disliked, "user_id", "full_outer").selectExpr("user_id", *counts, *rates)


def recent_views(views: DataFrame, limit: int) -> DataFrame:
    """Each visitor's latest ``limit`` items, most recent first."""
    order = [F.col("last_ts").desc(), F.col("content_id")]
    return top_k(views.select("user_id", "content_id", "last_ts"), ["user_id"], order, limit, rank="recency_rank")


class VisitorModel:
    """The tables of the visitor model, each planned when first asked for.

    ``stored`` writes the shared ones once, for jobs that read them several times.
    """

    def __init__(self, events: DataFrame, contents: DataFrame, content_tags: DataFrame, vectors: DataFrame,
                 now: datetime, cfg: RecConfig, provider: DataFrame | None = None, stored: bool = False):
        self.keep = materialize if stored else (lambda df: df)
        self.events, self.contents, self.content_tags, self.vectors = events, contents, content_tags, vectors
        self.now, self.cfg, self.provider = now, cfg, provider

    @cached_property
    def views(self) -> DataFrame:
        return aggregate_views(self.events)

    @cached_property
    def shown(self) -> DataFrame:
        return shown_items(self.events)

    @cached_property
    def answer_weights(self) -> DataFrame:
        return survey_tag_weights(self.events)

    @cached_property
    def answered_demographics(self) -> DataFrame:
        return answered_demographics(self.events)

    @cached_property
    def visitors(self) -> DataFrame:
        return self.events.select("user_id")

    @cached_property
    def signals(self) -> DataFrame:
        """user_id, content_id, visits, dwell..., strength, outcome, decay, weight"""
        return self.keep(item_signals(score_views(self.views, self.contents, self.now, self.cfg)))

    @cached_property
    def positives(self) -> DataFrame:
        return positives(self.signals)

    @cached_property
    def explicit_negatives(self) -> DataFrame:
        return self.signals.filter("outcome = 'negative'").select("user_id", "content_id", "weight")

    @cached_property
    def negatives(self) -> DataFrame:
        """user_id, content_id, weight; soft negatives included"""
        return self.keep(negatives(self.explicit_negatives, soft_negatives(self.shown, self.signals, self.now, self.cfg)))

    @cached_property
    def seen(self) -> DataFrame:
        """(user_id, content_id) that recommendations leave out: viewed or in the negatives."""
        viewed = self.signals.select("user_id", "content_id")
        if not self.cfg.soft_negatives_block:
            return viewed
        return viewed.unionByName(self.negatives.select("user_id", "content_id")).distinct()

    @cached_property
    def demographics(self) -> DataFrame:
        return self.keep(demographics(self.answered_demographics, self.provider))

    @cached_property
    def tag_affinity(self) -> DataFrame:
        """user_id, key, weight in [0, 1]"""
        amounts = (
            item_tag_weights(self.positives, self.content_tags)
            .unionByName(self.answer_weights)
            .unionByName(demographic_tag_weights(self.demographics))
        )
        return self.keep(fold_keys(amounts))

    @cached_property
    def tag_aversion(self) -> DataFrame:
        return self.keep(fold_keys(item_tag_weights(self.explicit_negatives, self.content_tags)))

    @cached_property
    def taste(self) -> DataFrame:
        return self.keep(weighted_centroid(self.positives, self.vectors, ["user_id"], "weight", "taste"))

    @cached_property
    def recency(self) -> DataFrame:
        latest = latest_view(self.signals)
        return latest.join(self.vectors, "content_id").select("user_id", F.col("vec").alias("recency"))

    @cached_property
    def behavior(self) -> DataFrame:
        return behavior(self.signals, self.negatives)

    @cached_property
    def users(self) -> DataFrame:
        """Every visitor with an event or an external profile."""
        users = self.visitors
        if self.provider is not None:
            users = users.unionByName(self.provider.select("user_id"))
        return users.distinct()


def history_rows(signals: DataFrame, contents: DataFrame) -> DataFrame:
    """Per-content history of each visitor with title and outcome."""
    return signals.join(contents.select("content_id", "title"), "content_id", "left").selectExpr(
        "user_id", "content_id", "coalesce(title, '') AS title", "visits", "dwell_seconds", "end_reason", "last_ts", "outcome"
    )


def demographic_values(demo: DataFrame) -> DataFrame:
    """(user_id, field, value): canonical demographic values in long form, junk dropped."""
    long = demo.unpivot("user_id", list(sv.DEMO_FIELDS), "field", "raw").filter("raw IS NOT NULL")
    return long.selectExpr("user_id", "field", f"{sv.canon_demo_value('field', 'raw')} AS value").filter("value IS NOT NULL")
