"""Synthetic visitors, list metrics and relevance reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.functions import survey as sv
from recspark.functions.ordered import top_k
from recspark.functions.vectors import dot, summed, unit, vector_sums
from recspark.operators import signals as sg
from recspark.config import RecConfig
from recspark.operators.scoring import Catalogue
from recspark.session import materialize

# Built-in personas as (key, seeds, answers).
BUILTIN_PERSONAS = [
    ("school_student_nl", "children, daily life, school, biography",
     {"age_group": ["16_18"], "province": ["Drenthe"], "q:personalization_theme": ["Daily Life"]}),
    ("university_student", "resistance, rescue, escape, aid and protection",
     {"q:personalization_theme": ["Resistance"], "q:personalization_interest": ["Personal stories"]}),
    ("researcher_forced_labour", "forced labor, administration, transit camp, deportation, registration",
     {"age_group": ["25_34"], "q:personalization_theme": ["Forced Labor", "Deportation"]}),
    ("historian_persecution", "anti-jewish measures, persecution, administration, deportation",
     {"q:personalization_theme": ["Deportation", "Family"]}),
    ("intl_tourist", "barrack, watchtower, entrance, memorial, transport", {"age_group": ["35_44"], "nationality": ["germany"]}),
    ("regional_tourist", "liberation, memorial, remembrance, postwar", {"age_group": ["55_64"], "province": ["Gelderland"]}),
    ("descendant", "biography, family, personal stories, remembrance, commemoration",
     {"age_group": ["65_74"], "personal_connection": ["yes"], "q:personalization_theme": ["Family"],
      "q:personalization_interest": ["Personal stories"]}),
    ("walk_in", "", {}),
]


def builtin_personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILTIN_PERSONAS, "persona string, text string, answers map<string,array<string>>")


def match_tags(texts: DataFrame, vocabulary: DataFrame, key: str = "id", top: int = 12) -> DataFrame:
    """(key, tag, weight): tags whose label holds tokens of the text, the best one weighs 1.

    A token scores 1 inside a label and 2 as a whole word of it. Labels are short, so
    their substrings form an index and the containment test is an equi join.
    """
    words = texts.selectExpr(key, r"explode(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) AS term").filter("length(term) > 2")
    counted = words.groupBy(key, "term").agg(F.expr("count(*) AS n"))
    labels = vocabulary.select("key").distinct().selectExpr("key", "lower(regexp_replace(key, '^[^:]*:', '')) AS label")
    pieces = labels.filter("length(label) >= 3").selectExpr(
        "key", "label",
        "explode(array_distinct(flatten(transform(sequence(1, length(label) - 2), i -> transform(sequence(3, length(label) - i + 1), n -> substring(label, i, n)))))) AS term",
    ).filter("term RLIKE '^[a-z0-9]+$'")
    index = pieces.selectExpr("key AS tag", "term", "IF(array_contains(regexp_extract_all(label, '([a-z0-9]+)', 1), term), 2, 1) AS points")
    scored = counted.join(index, "term").groupBy(key, "tag").agg(F.expr("CAST(sum(n * points) AS DOUBLE) AS score"))
    best = top_k(scored, [key], [F.desc("score"), F.col("tag")], top)
    return best.selectExpr(key, "lower(tag) AS tag", f"score / max(score) OVER (PARTITION BY {key}) AS weight")


def inferred_answers(text: str) -> str:
    """Map of coarse demographics that a prompt mentions."""
    t = f"lower({text})"
    gender = rf"CASE WHEN {t} RLIKE 'female|woman|women' THEN 'female' WHEN {t} RLIKE 'male|\\bman\\b' THEN 'male' END"
    age = rf"try_cast(regexp_extract({t}, '\\b([0-9]{{2}})\\b', 1) AS INT)"
    group = (
        f"CASE WHEN {t} RLIKE 'child|teen|young|student|school' THEN '18_24' WHEN {t} RLIKE 'elderly|older|senior|survivor|grand' THEN '65_plus' "
        f"WHEN {age} < 25 THEN '18_24' WHEN {age} < 35 THEN '25_34' WHEN {age} < 45 THEN '35_44' WHEN {age} < 55 THEN '45_54' "
        f"WHEN {age} < 65 THEN '55_64' WHEN {age} IS NOT NULL THEN '65_plus' END"
    )
    return f"map_filter(map('gender', array({gender}), 'age_group', array({group})), (k, v) -> v[0] IS NOT NULL)"


class PreviewModel:
    """Visitor-model tables built from specs instead of events.

    personas: user_id, answers; tags: user_id, key, amount; likes: user_id, content_id.
    """

    def __init__(self, personas: DataFrame, tags: DataFrame, likes: DataFrame, vectors: DataFrame):
        self.personas, self.tags, self.likes, self.vectors = personas, tags, likes, vectors

    @cached_property
    def positives(self) -> DataFrame:
        return self.likes.selectExpr("user_id", "content_id", "1D AS weight", "CAST(NULL AS TIMESTAMP) AS last_ts")

    @cached_property
    def seen(self) -> DataFrame:
        return self.likes.select("user_id", "content_id").distinct()

    @cached_property
    def taste(self) -> DataFrame:
        return sg.weighted_centroid(self.likes, self.vectors, ["user_id"], "1D", "taste")

    @cached_property
    def recency(self) -> DataFrame:
        return self.taste.limit(0).selectExpr("user_id", "taste AS recency")

    @cached_property
    def tag_affinity(self) -> DataFrame:
        given = self.personas.selectExpr("user_id", f"inline({sv.survey_affinity('answers')}) AS (key, amount)")
        return sg.fold_keys(self.tags.select("user_id", "key", "amount").unionByName(given))

    @cached_property
    def tag_aversion(self) -> DataFrame:
        return self.tag_affinity.limit(0)


def scenario_requests(users: DataFrame, scenarios: list[dict]) -> DataFrame:
    """One request per visitor and scenario ({name, filter?, near_lat?, near_lon?, geo_radius_m?})."""

    def cell(value, kind):
        return "CAST(NULL AS %s)" % kind if value is None else (sv.sql_text(value) if kind == "STRING" else f"{float(value)}D")

    rows = ", ".join(
        f"struct({cell(s.get('name', 'scenario'), 'STRING')} AS scenario, {cell(s.get('filter'), 'STRING')} AS filter, "
        f"{cell(s.get('near_lat'), 'DOUBLE')} AS lat, {cell(s.get('near_lon'), 'DOUBLE')} AS lon, {cell(s.get('geo_radius_m'), 'DOUBLE')} AS radius_m)"
        for s in scenarios
    )
    return users.selectExpr("user_id", f"inline(array({rows}))").selectExpr(
        "concat(user_id, '|', scenario) AS request_id", "user_id", "filter", "lat", "lon", "radius_m"
    )


def persona_model(personas: DataFrame, catalogue: Catalogue, likes: DataFrame, top: int = 12) -> PreviewModel:
    """The preview model of described visitors (persona, text, answers): tags that the text names, the answers given and inferred, and likes.

    A visitor's own answers win over those its text suggests.
    """
    vocabulary = catalogue.tags.select("key").distinct()
    tags = match_tags(personas.select("persona", "text"), vocabulary, key="persona", top=top).selectExpr("persona AS user_id", "tag AS key", "weight AS amount")
    answers = f"map_concat(map_filter({inferred_answers('text')}, (k, v) -> NOT map_contains_key(coalesce(answers, map()), k)), coalesce(answers, map()))"
    return PreviewModel(personas.selectExpr("persona AS user_id", f"{answers} AS answers"), tags, likes, catalogue.vectors)


def evaluate_personas(personas: DataFrame, scenarios: list[dict], catalogue: Catalogue, likes: DataFrame, cfg: RecConfig) -> DataFrame:
    """(request_id, persona, scenario and the list metrics): what every persona would be shown in every scenario.

    Personas without a tag, an answer or a like get the cold lists, like new visitors.
    """
    from recspark.operators.recommend import recommend

    model = persona_model(personas, catalogue, likes)
    requests = materialize(scenario_requests(personas.selectExpr("persona AS user_id"), scenarios))
    recs = recommend(requests, catalogue, model, cfg)
    shown = recs.items.selectExpr("request_id", "content_id", "role", "relevance_score")
    told = requests.selectExpr("request_id", "user_id AS persona", "substring(request_id, length(user_id) + 2) AS scenario")
    return told.join(recs.diagnostics.select("request_id", "strategy", "cold_start_fallback"), "request_id").join(list_metrics(shown, catalogue), "request_id", "left")


def list_metrics(items: DataFrame, catalogue: Catalogue, key: str = "request_id") -> DataFrame:
    """Per list: size, targets, mean target score, distinct tags, distractor flag, diversity. The items are made once."""
    items = materialize(items.select(key, "content_id", "role", "relevance_score"))
    base = items.groupBy(key).agg(
        F.expr("count(*) AS n_items"), F.expr("count_if(role <> 'distractor') AS n_targets"),
        F.expr("avg(IF(role <> 'distractor', coalesce(relevance_score, 0D), NULL)) AS avg_target_score"),
        F.expr("bool_or(role = 'distractor') AS distractor_present"),
    )
    tags = (
        items.select(key, "content_id").join(catalogue.tags.select("content_id", F.col("key").alias("tag")), "content_id")
        .select(key, "tag").distinct().groupBy(key).agg(F.expr("count(*) AS distinct_tags"))
    )
    joined = base.join(tags, key, "left").join(diversity(items, catalogue, key), key, "left")
    return joined.withColumn("distinct_tags", F.expr("coalesce(distinct_tags, 0)"))


def diversity(items: DataFrame, catalogue: Catalogue, key: str = "request_id") -> DataFrame:
    """(key, intra_list_diversity): mean 1 - cosine over the pairs of a list, null under two.

    With unit vectors the pair sum is (|sum|^2 - sum |v|^2) / 2, so no pair is formed; the sum is one vector aggregate.
    Each vector is brought to unit length once, not once for each list.
    """
    have = catalogue.vectors.filter("vec IS NOT NULL").selectExpr("content_id", f"{unit('vec')} AS u")
    units = items.select(key, "content_id").join(materialize(have.selectExpr("*", "aggregate(u, 0D, (a, x) -> a + x * x) AS q")), "content_id")
    sums = units.groupBy(key).agg(*vector_sums("u", catalogue.dim), F.expr("count(*) AS n"), F.expr("sum(q) AS q"))
    sums = sums.selectExpr(key, "n", "q", f"{summed(catalogue.dim)} AS s")
    return sums.selectExpr(key, f"IF(n < 2, NULL, 1D - ({dot('s', 's')} - q) / (n * (n - 1D))) AS intra_list_diversity")


def facet_spread(items: DataFrame, tags: DataFrame, key: str = "request_id") -> DataFrame:
    return items.select(key, "content_id").join(tags.select("content_id", "facet"), "content_id").groupBy(key, "facet").agg(
        F.expr("count(*) AS n")
    )


def relevance_report(verdicts: DataFrame) -> DataFrame:
    """(persona, n, mean_score, share_relevant) per persona and for all (persona null)."""
    return verdicts.rollup("persona").agg(
        F.expr("count(*) AS n"), F.expr("avg(score) AS mean_score"), F.expr("avg(IF(score >= 4, 1D, 0D)) AS share_relevant")
    )
