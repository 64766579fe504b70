"""The full recommender for all requests at once: pool, fallbacks, scores, rerank, distractor."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.config import FEATURES, RecConfig
from recspark.operators import candidates as cg
from recspark.operators.knn import nearest
from recspark.operators.scoring import Catalogue, apply_policy, explained, fuse, mmr, score_candidates, tag_score
from recspark.session import materialize

# requests: request_id, user_id, filter (nullable), lat, lon, radius_m (nullable)
REQUEST_SCHEMA = "request_id string, user_id string, filter string, lat double, lon double, radius_m double"
GEO = "(lat IS NOT NULL AND lon IS NOT NULL AND radius_m IS NOT NULL)"
CONSTRAINED = f"(coalesce(filter, '') <> '' OR {GEO})"


@dataclass(frozen=True)
class Recommendations:
    items: DataFrame        # request_id, user_id, rank, content_id, role, relevance_score, breakdown, features
    diagnostics: DataFrame  # one row per request


def one_request_per_user(users: DataFrame) -> DataFrame:
    nulls = ["CAST(NULL AS STRING) AS filter", *[f"CAST(NULL AS DOUBLE) AS {c}" for c in ("lat", "lon", "radius_m")]]
    return users.selectExpr("user_id AS request_id", "user_id", *nulls)


def open_pool(users: DataFrame, catalogue: Catalogue, model, cfg: RecConfig) -> DataFrame:
    """Unconstrained pool per user; an item found twice keeps the first generator.

    With ``pool_before_seen`` both generators take their top k before seen items are removed, else of the unseen items.
    """
    k = cfg.pool_per_generator
    seen = None if cfg.pool_before_seen else model.seen
    taste = model.taste.join(users, "user_id", "left_semi")
    affinity = model.tag_affinity.join(users, "user_id", "left_semi")
    semantic = cg.semantic_recall(taste, catalogue.vectors, k, seen).selectExpr("*", "0 AS priority")
    by_tag = cg.tag_recall(affinity, catalogue.tags_nkey, cfg, seen).selectExpr("*", "1 AS priority")
    return semantic.unionByName(by_tag).groupBy("user_id", "content_id").agg(
        F.expr("min_by(struct(IF(priority = 0, 'semantic', 'tag') AS generated_by, base_score), priority) AS g")
    ).select("user_id", "content_id", "g.generated_by", "g.base_score")


def constrained_pool(requests: DataFrame, catalogue: Catalogue, seen: DataFrame | None, cfg: RecConfig) -> DataFrame:
    """(request_id, user_id, content_id, generated_by): tag filter, radius, or both, which are met before the cut."""
    k = cfg.pool_per_generator
    by_filter = "coalesce(filter, '') <> ''"
    by_tag = cg.filter_recall(requests.filter(f"{by_filter} AND NOT {GEO}"), catalogue.values, seen, k).selectExpr("request_id", "content_id", "'filter' AS generated_by")
    by_geo = cg.geo_recall(requests.filter(f"NOT ({by_filter}) AND {GEO}"), catalogue.contents, seen, k).selectExpr("request_id", "content_id", "'geo' AS generated_by")
    by_both = cg.filtered_geo_recall(requests.filter(f"{by_filter} AND {GEO}"), catalogue.values, catalogue.contents, seen, k).selectExpr("request_id", "content_id", "'filter+geo' AS generated_by")
    hits = by_tag.unionByName(by_geo).unionByName(by_both)
    return requests.select("request_id", "user_id").join(hits, "request_id").select("request_id", "user_id", "content_id", "generated_by")


def candidate_pool(requests: DataFrame, catalogue: Catalogue, model, cfg: RecConfig) -> tuple[DataFrame, DataFrame]:
    """(candidates, pool diagnostics) of every request, fallbacks included."""
    seen = model.seen
    free = requests.filter(f"NOT {CONSTRAINED}").select("request_id", "user_id")
    bound = requests.filter(CONSTRAINED)
    users = free.select("user_id").distinct()
    order = cg.sample_order(catalogue.contents, cfg.seed)

    pool = materialize(open_pool(users, catalogue, model, cfg))
    sizes = pool.groupBy("user_id").agg(F.expr("count(*) AS pool_size"))
    fresh = materialize(pool.join(seen, ["user_id", "content_id"], "left_anti"))
    dry = users.join(fresh, "user_id", "left_anti")
    sampled = cg.sample_outside(dry, seen.join(dry, "user_id", "left_semi"), order, cfg.pool_per_generator, key="user_id")
    per_user = fresh.selectExpr("user_id", "content_id", "generated_by", "false AS cold_fallback").unionByName(
        sampled.selectExpr("user_id", "content_id", "'distractor' AS generated_by", "true AS cold_fallback")
    )
    open_rows = free.join(per_user, "user_id").selectExpr(
        "request_id", "user_id", "content_id", "generated_by", "cold_fallback", "false AS seen_fallback"
    )

    bound_fresh = materialize(constrained_pool(bound, catalogue, seen, cfg))
    bound_rows = bound_fresh.selectExpr("*", "false AS cold_fallback", "false AS seen_fallback")
    if cfg.filter_reshow_when_exhausted:
        exhausted = bound.join(bound_fresh, "request_id", "left_anti")
        again = constrained_pool(exhausted, catalogue, None, cfg)
        bound_rows = bound_rows.unionByName(again.selectExpr("*", "false AS cold_fallback", "true AS seen_fallback"))
    rows = materialize(open_rows.unionByName(bound_rows))

    counts = rows.groupBy("request_id").agg(
        F.expr("count(*) AS scored"), F.expr("bool_or(cold_fallback) AS cold_start_fallback"),
        F.expr("bool_or(seen_fallback) AS seen_fallback"), F.expr("min(generated_by) AS g"),
    )
    warm = model.positives.select("user_id").distinct().selectExpr("user_id", "true AS warm")
    info = (
        requests.join(warm, "user_id", "left")
        .join(sizes, "user_id", "left")
        .join(counts, "request_id", "left")
        .selectExpr(
            "request_id", "user_id", "filter", f"{CONSTRAINED} AS constrained", "lat IS NOT NULL AND lon IS NOT NULL AS geo",
            "IF(coalesce(cold_start_fallback, false) OR warm IS NULL, 'cold', 'warm') AS strategy",
            f"IF(NOT {CONSTRAINED}, coalesce(pool_size, 0) + IF(cold_start_fallback, scored, 0), coalesce(scored, 0)) AS pool_size",
            "coalesce(scored, 0) AS scored",
            "coalesce(cold_start_fallback, false) AS cold_start_fallback",
            "coalesce(seen_fallback, false) AS seen_fallback",
            f"CASE WHEN scored IS NULL THEN IF({CONSTRAINED}, 'empty_filter', 'no_content') END AS reason",
        )
    )
    return rows.select("request_id", "user_id", "content_id", "generated_by"), info


def distractor_slot(cfg: RecConfig) -> str:
    """Seeded choice of one of the configured 1-based positions."""
    slots = ", ".join(str(s) for s in cfg.distractor_slots)
    return f"element_at(array({slots}), CAST(conv(substring(md5(concat(request_id, ':slot:{cfg.seed}')), 1, 6), 16, 10) AS INT) % {len(cfg.distractor_slots)} + 1)"


def distractor_gate(cfg: RecConfig) -> str:
    """Whether a request gets a distractor: a seeded draw against the probability."""
    if not cfg.distractor_enabled or cfg.distractor_probability <= 0:
        return "false"
    if cfg.distractor_probability >= 1:
        return "true"
    draw = f"CAST(conv(substring(md5(concat(request_id, ':gate:{cfg.seed}')), 1, 6), 16, 10) AS INT) / 16777216D"
    return f"({draw} < {cfg.distractor_probability}D)"


def open_distractors(requests: DataFrame, ranked: DataFrame, catalogue: Catalogue, model, cfg: RecConfig) -> DataFrame:
    """(request_id, user_id, content_id): an off-profile item outside the seen and ranked ones."""
    users = requests.select("user_id").distinct()
    shown = ranked.join(requests.select("request_id", "user_id"), "request_id").select("request_id", "user_id", "content_id")
    barred = requests.select("request_id", "user_id").join(model.seen, "user_id").select("request_id", "user_id", "content_id").unionByName(shown)
    found = None
    if cfg.distractor_strategy == "max_dissimilar":
        away = model.taste.join(users, "user_id", "left_semi").selectExpr("user_id AS qid", "transform(taste, x -> -x) AS qvec")
        far = nearest(away, catalogue.vectors, cfg.pool_per_generator).selectExpr("qid AS user_id", "content_id", "rank")
        far = requests.select("request_id", "user_id").join(far, "user_id").join(
            barred.select("request_id", "content_id"), ["request_id", "content_id"], "left_anti"
        )
        found = materialize(far.groupBy("request_id", "user_id").agg(F.expr("min_by(content_id, rank) AS content_id")))
    rest = requests if found is None else requests.join(found, "request_id", "left_anti")
    order = cg.sample_order(catalogue.contents, cfg.seed + 1)
    n = 20 if cfg.distractor_strategy == "unexplored_theme" else 1
    drawn = cg.sample_outside(rest, barred.join(rest.select("request_id"), "request_id", "left_semi"), order, n)
    drawn = drawn.join(rest.select("request_id", "user_id"), "request_id")
    if n > 1:
        item_keys = catalogue.tags.selectExpr("content_id", "lower(key) AS key").distinct()
        overlap = drawn.join(item_keys, "content_id").join(model.tag_affinity.select("user_id", "key"), ["user_id", "key"])
        overlap = overlap.groupBy("request_id", "content_id").agg(F.expr("count(*) AS shared"))
        drawn = drawn.join(overlap, ["request_id", "content_id"], "left")
        drawn = drawn.groupBy("request_id", "user_id").agg(
            F.expr("min_by(content_id, struct(coalesce(shared, 0), draw)) AS content_id")
        )
    picked = drawn.select("request_id", "user_id", "content_id")
    return picked if found is None else found.select("request_id", "user_id", "content_id").unionByName(picked)


def recommend(requests: DataFrame, catalogue: Catalogue, model, cfg: RecConfig,
              policy: DataFrame | None = None) -> Recommendations:
    """Ranked items and diagnostics of every request."""
    pool, info = candidate_pool(requests, catalogue, model, cfg)
    located = requests.filter("lat IS NOT NULL AND lon IS NOT NULL").select("request_id", "lat", "lon")
    scored = fuse(score_candidates(pool, catalogue, model, cfg, located), cfg)
    learned = cfg.ranking_mode == "bandit" and policy is not None
    if learned:
        scored = apply_policy(scored, policy, cfg)
    scored = materialize(scored.drop("breakdown", "features"))
    gate = distractor_gate(cfg)
    longest = f"IF({gate}, {max(cfg.final_limit - 1, 1)}, {max(cfg.final_limit, 1)})"
    ordered = materialize(mmr(scored, catalogue, cfg).filter(f"rank <= {longest}"))
    lengths = ordered.groupBy("request_id").agg(F.expr("count(*) AS n"))
    asked = requests.filter(gate).join(lengths, "request_id")

    bound = asked.filter(CONSTRAINED)
    leftovers = scored.join(bound.select("request_id"), "request_id", "left_semi").join(ordered, ["request_id", "content_id"], "left_anti")
    least = leftovers.groupBy("request_id", "user_id").agg(
        F.expr(f"min_by(struct(content_id, final_score, {', '.join(FEATURES)}), struct(final_score, content_id)) AS d")
    ).select("request_id", "user_id", "d.*")
    least = explained(least, cfg).select("request_id", "user_id", "content_id", "final_score", "breakdown", "features")
    free = asked.filter(f"NOT {CONSTRAINED}")
    off = score_distractors(open_distractors(free, ordered, catalogue, model, cfg), catalogue, model, cfg)
    distractors = least.unionByName(off).join(lengths, "request_id").selectExpr(
        "request_id", "user_id", "content_id", "final_score", "breakdown", "features",
        f"CAST(least({distractor_slot(cfg)}, n + 1) AS INT) AS rank",
    )

    distractors = materialize(distractors)
    shift = distractors.selectExpr("request_id", "rank AS slot")
    targets = explained(ordered.join(scored, ["request_id", "content_id"]), cfg).join(shift, "request_id", "left").selectExpr(
        "request_id", "user_id", "CAST(rank + IF(rank >= slot, 1, 0) AS INT) AS rank", "content_id",
        "'target' AS role", "final_score AS relevance_score", "breakdown", "features",
    )
    extra = distractors.selectExpr(
        "request_id", "user_id", "rank", "content_id", "'distractor' AS role", "final_score AS relevance_score",
        "breakdown", "features",
    )
    placed = distractors.selectExpr("request_id", "content_id AS distractor_id", "rank AS distractor_slot")
    diagnostics = info.join(placed, "request_id", "left").selectExpr(
        "*", f"'{'bandit' if learned else 'static'}' AS ranking",
        f"CASE WHEN NOT {gate} OR distractor_id IS NOT NULL OR scored = 0 THEN NULL "
        "WHEN constrained THEN 'filtered_set_exhausted' ELSE 'no_candidate' END AS distractor_missing",
    )
    return Recommendations(items=targets.unionByName(extra), diagnostics=diagnostics)


def score_distractors(picks: DataFrame, catalogue: Catalogue, model, cfg: RecConfig) -> DataFrame:
    """Distractors are scored on taste and tags only and carry no features."""
    from recspark.functions.vectors import cosine

    similar = picks.join(catalogue.vectors, "content_id", "left").join(model.taste, "user_id", "left").selectExpr(
        "request_id", "user_id", "content_id",
        f"IF(vec IS NULL OR taste IS NULL, 0D, ({cosine('taste', 'vec')} + 1D) / 2D) AS semantic",
    )
    tags = tag_score(picks, catalogue.tags_nkey, model.tag_affinity, "tag")
    both = similar.join(tags, ["request_id", "content_id"], "left").selectExpr(
        "request_id", "user_id", "content_id", "semantic", "coalesce(tag, 0D) AS tag"
    )
    fused = fuse(both, cfg, ("semantic", "tag"))
    return fused.selectExpr(
        "request_id", "user_id", "content_id", "final_score", "breakdown", "CAST(array() AS ARRAY<DOUBLE>) AS features"
    )


def served_rows(recs: Recommendations, ts: str) -> DataFrame:
    """One served-log row per request with its nested items (bounded by the list length)."""
    item = "struct(content_id AS id, rank, role, relevance_score, breakdown, features)"
    lists = recs.items.groupBy("request_id").agg(
        F.expr(f"array_sort(collect_list({item}), (a, b) -> a.rank - b.rank) AS items")
    )
    return recs.diagnostics.join(lists, "request_id", "left").selectExpr(
        "request_id", "user_id", f"{ts} AS ts", "strategy", "filter", "cold_start_fallback AS cold_start", "ranking",
        "distractor_id", "items",
    )
