"""Queries of recall, scoring and the full recommender."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace
from functools import cached_property

from pyspark.sql import functions as F

from recspark.functions.ordered import top_k
from recspark.operators import candidates as cg
from recspark.operators import recommend as rc
from recspark.operators.knn import nearest
from recspark.operators.scoring import Catalogue, fuse, score_candidates
from recspark.plans.oracle import CTES, NOW, cte
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import CFG, World
from recspark.session import run_folder
from recspark.sources import logs


class RecWorld(World):
    @cached_property
    def catalogue(self) -> Catalogue:
        return Catalogue(self.contents, self.content_tags, self.vectors)

    @cached_property
    def requests(self):
        """One request per visitor: a third by location tag, a third by position, a third open."""
        return self.model.events.select("user_id").distinct().selectExpr(
            "user_id AS request_id", "user_id", "CAST(user_id AS BIGINT) AS u"
        ).selectExpr(
            "request_id", "user_id",
            "IF(u % 3 = 0, concat('AiARLocationBarrack', u % 7), NULL) AS filter",
            "IF(u % 3 = 1 OR u % 6 = 0, 52.75D + (u % 100) * 0.0005D, NULL) AS lat",
            "IF(u % 3 = 1 OR u % 6 = 0, 9.90D + (u % 5) * 0.0005D, NULL) AS lon",
            "IF(u % 3 = 1 OR u % 6 = 0, 400D, NULL) AS radius_m",
        )

    @cached_property
    def open_requests(self):
        return rc.one_request_per_user(self.model.events.select("user_id").distinct())


cte("ctag_keys", r"""
SELECT content_id, pos, weight, lower(facet) || ':' || trim(regexp_replace(lower(label), '[\s_-]+', ' ', 'g')) AS nkey FROM ctags
""")
cte("aff_keys", r"""
SELECT user_id, key, weight, split_part(key, ':', 1) || ':' ||
       trim(regexp_replace(lower(substr(key, strpos(key, ':') + 1)), '[\s_-]+', ' ', 'g')) AS nkey FROM affinity
""")
cte("av_keys", r"""
SELECT user_id, key, weight, split_part(key, ':', 1) || ':' ||
       trim(regexp_replace(lower(substr(key, strpos(key, ':') + 1)), '[\s_-]+', ' ', 'g')) AS nkey FROM aversion
""")
cte("sem_pool", """
SELECT user_id, content_id, score FROM (
  SELECT t.user_id, v.content_id, list_cosine_similarity(t.v, v.v) AS score,
         row_number() OVER (PARTITION BY t.user_id ORDER BY list_cosine_similarity(t.v, v.v) DESC, v.content_id) AS rn
  FROM taste t CROSS JOIN vec v) WHERE rn <= 30
""")
cte("tag_pool", """
SELECT user_id, content_id, score FROM (
  SELECT user_id, content_id, CAST(count(*) AS DOUBLE) AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, content_id) AS rn
  FROM (SELECT DISTINCT user_id, nkey FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, key) AS kr FROM aff_keys) WHERE kr <= 20)
  JOIN (SELECT DISTINCT content_id, nkey FROM ctag_keys) USING (nkey) GROUP BY user_id, content_id) WHERE rn <= 30
""")
cte("seen_items", """
SELECT user_id, content_id FROM views_agg UNION SELECT user_id, content_id FROM neg_items
""")
cte("open_cand", """
SELECT user_id, content_id, CASE WHEN min(p) = 0 THEN 'semantic' ELSE 'tag' END AS generated_by
FROM (SELECT user_id, content_id, 0 AS p FROM sem_pool UNION ALL SELECT user_id, content_id, 1 FROM tag_pool) x
WHERE NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = x.user_id AND s.content_id = x.content_id)
GROUP BY user_id, content_id
""")
cte("reqs", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN user_id % 3 = 0 THEN 'barrack ' || (user_id % 7) END AS value,
  CASE WHEN user_id % 3 = 1 OR user_id % 6 = 0 THEN 52.75 + (user_id % 100) * CAST(0.0005 AS DOUBLE) END AS lat,
  CASE WHEN user_id % 3 = 1 OR user_id % 6 = 0 THEN CAST(9.90 AS DOUBLE) + (user_id % 5) * CAST(0.0005 AS DOUBLE) END AS lon FROM events
""")
cte("item_values", """
SELECT DISTINCT content_id, CASE WHEN label LIKE 'AiARLocation%' THEN 'barrack ' || right(label, 1) ELSE lower(replace(replace(label, '_', ' '), '-', ' ')) END AS value FROM ctags
""")
cte("filter_hits", """
SELECT user_id, content_id FROM (
  SELECT r.user_id, i.content_id, row_number() OVER (PARTITION BY r.user_id ORDER BY i.content_id) AS rn
  FROM reqs r JOIN item_values i USING (value)
  WHERE NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = r.user_id AND s.content_id = i.content_id)) WHERE rn <= 30
""")
cte("geo_hits", """
SELECT user_id, content_id, d FROM (
  SELECT user_id, content_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d, content_id) AS rn FROM (
    SELECT r.user_id, c.content_id, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - r.lat) / 2), 2)
           + cos(radians(r.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - r.lon) / 2), 2)))) AS d
    FROM reqs r JOIN cont c ON r.lat IS NOT NULL) x
  WHERE d <= 400 AND NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = x.user_id AND s.content_id = x.content_id)) WHERE rn <= 30
""")
cte("cand_scores", """
SELECT c.user_id, c.content_id,
  coalesce((list_cosine_similarity(t.v, cv.v) + 1) / 2, 0) AS semantic,
  coalesce((SELECT max(greatest((list_cosine_similarity(cv.v, lv.v) + 1) / 2 * p.weight / p.top, 0)) FROM (
     SELECT *, max(weight) OVER (PARTITION BY user_id) AS top FROM pos_items) p JOIN vec lv ON lv.content_id = p.content_id WHERE p.user_id = c.user_id), 0) AS affinity,
  coalesce((SELECT sum(a.weight * k.weight) FROM aff_keys a JOIN ctag_keys k ON k.nkey = a.nkey WHERE a.user_id = c.user_id AND k.content_id = c.content_id)
     / (SELECT sum(weight) FROM affinity a WHERE a.user_id = c.user_id), 0) AS tag,
  coalesce((list_cosine_similarity(r.v, cv.v) + 1) / 2, 0) AS recency,
  coalesce((SELECT sum(a.weight * k.weight) FROM av_keys a JOIN ctag_keys k ON k.nkey = a.nkey WHERE a.user_id = c.user_id AND k.content_id = c.content_id)
     / (SELECT sum(weight) FROM aversion a WHERE a.user_id = c.user_id), 0) AS aversion, cv.v
FROM open_cand c JOIN vec cv ON cv.content_id = c.content_id LEFT JOIN taste t ON t.user_id = c.user_id LEFT JOIN recency r ON r.user_id = c.user_id
""")
cte("fused", """
SELECT *, CAST(0.20 AS DOUBLE) * semantic + CAST(0.10 AS DOUBLE) * affinity + CAST(0.45 AS DOUBLE) * least(tag, 1)
        + CAST(0.05 AS DOUBLE) * recency + CAST(-0.30 AS DOUBLE) * least(aversion, 1) AS score FROM cand_scores
""")
cte("mmr_walk", """
SELECT user_id, 1 AS step, [arg_min({'id': content_id, 'v': v}, (-score, content_id))] AS sel FROM fused GROUP BY user_id
UNION ALL
SELECT w.user_id, w.step + 1, list_append(w.sel, arg_min({'id': c.content_id, 'v': c.v},
   (-(0.7 * c.score - 0.3 * list_max(list_transform(w.sel, lambda s: list_cosine_similarity(s.v, c.v)))), -c.score, c.content_id)))
FROM mmr_walk w JOIN fused c ON c.user_id = w.user_id AND NOT list_contains(list_transform(w.sel, lambda s: s.id), c.content_id)
WHERE w.step < 9 GROUP BY w.user_id, w.step, w.sel
""")
cte("mmr_list", """
SELECT user_id, s.id AS content_id, rank FROM (
  SELECT user_id, unnest(sel) AS s, generate_subscripts(sel, 1) AS rank FROM (
    SELECT user_id, arg_max(sel, step) AS sel FROM mmr_walk GROUP BY user_id))
""")
cte("away_pool", """
SELECT user_id, content_id, rn FROM (
  SELECT t.user_id, v.content_id, row_number() OVER (PARTITION BY t.user_id ORDER BY list_cosine_similarity(t.v, v.v), v.content_id) AS rn
  FROM taste t CROSS JOIN vec v) WHERE rn <= 30
""")
cte("distractor", """
SELECT a.user_id, arg_min(a.content_id, rn) AS content_id,
       least(CASE WHEN CAST('0x' || substr(md5(a.user_id || ':slot:0'), 1, 6) AS INT) % 2 = 0 THEN 3 ELSE 4 END, any_value(l.n) + 1) AS slot
FROM away_pool a JOIN (SELECT user_id, count(*) AS n FROM mmr_list GROUP BY user_id) l ON l.user_id = a.user_id
WHERE NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = a.user_id AND s.content_id = a.content_id)
  AND NOT EXISTS (SELECT 1 FROM mmr_list s WHERE s.user_id = a.user_id AND s.content_id = a.content_id)
GROUP BY a.user_id
""")
cte("rec_items", """
SELECT l.user_id, l.content_id, 'target' AS role, l.rank + CASE WHEN l.rank >= d.slot THEN 1 ELSE 0 END AS rank, f.score
FROM mmr_list l JOIN fused f ON f.user_id = l.user_id AND f.content_id = l.content_id LEFT JOIN distractor d ON d.user_id = l.user_id
UNION ALL
SELECT d.user_id, d.content_id, 'distractor', d.slot, 0.20 * coalesce((list_cosine_similarity(t.v, v.v) + 1) / 2, 0)
  + 0.45 * least(coalesce((SELECT sum(a.weight * k.weight) FROM aff_keys a JOIN ctag_keys k ON k.nkey = a.nkey WHERE a.user_id = d.user_id AND k.content_id = d.content_id)
     / (SELECT sum(weight) FROM affinity a WHERE a.user_id = d.user_id), 0), 1)
FROM distractor d JOIN vec v ON v.content_id = d.content_id LEFT JOIN taste t ON t.user_id = d.user_id
""")


@query("semantic_recall", "SELECT user_id, content_id, round(score, 6) + 0.0 AS base_score FROM sem_pool")
def semantic_recall(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    return cg.semantic_recall(w.model.taste, w.vectors, CFG.pool_per_generator).selectExpr(
        "user_id", "content_id", *r6("base_score"))


@query("tag_recall", "SELECT user_id, content_id, score AS base_score FROM tag_pool")
def tag_recall(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    return cg.tag_recall(w.model.tag_affinity, w.catalogue.tags_nkey, CFG)


@query("filter_recall", "SELECT user_id AS request_id, content_id FROM filter_hits")
def filter_recall(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    return cg.filter_recall(w.requests.filter("filter IS NOT NULL"), w.catalogue.values, w.model.seen, 30)


@query("geo_recall", "SELECT user_id AS request_id, content_id, round(-d, 6) AS base_score FROM geo_hits")
def geo_recall(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    hits = cg.geo_recall(w.requests.filter("lat IS NOT NULL"), w.contents, w.model.seen, 30)
    return hits.selectExpr("request_id", "content_id", *r6("base_score"))


cte("both_hits", """
SELECT user_id, content_id FROM (
  SELECT user_id, content_id, row_number() OVER (PARTITION BY user_id ORDER BY d, content_id) AS rn FROM (
    SELECT r.user_id, c.content_id, 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - r.lat) / 2), 2)
           + cos(radians(r.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - r.lon) / 2), 2)))) AS d
    FROM reqs r JOIN cont c ON r.lat IS NOT NULL JOIN item_values i ON i.content_id = c.content_id AND i.value = r.value) x
  WHERE d <= 400 AND NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = x.user_id AND s.content_id = x.content_id)) WHERE rn <= 30
""")


@query("constrained_pool", """
SELECT user_id AS request_id, content_id, 'filter' AS generated_by FROM filter_hits JOIN reqs USING (user_id) WHERE lat IS NULL
UNION ALL SELECT user_id, content_id, 'geo' FROM geo_hits JOIN reqs USING (user_id) WHERE value IS NULL
UNION ALL SELECT user_id, content_id, 'filter+geo' FROM both_hits
""")
def constrained_pool(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    bound = w.requests.filter(rc.CONSTRAINED)
    return rc.constrained_pool(bound, w.catalogue, w.model.seen, CFG).select("request_id", "content_id", "generated_by")


@query("open_candidates", "SELECT user_id, content_id, generated_by FROM open_cand")
def open_candidates(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    pool = rc.open_pool(w.open_requests.select("user_id"), w.catalogue, w.model, CFG)
    return pool.join(w.model.seen, ["user_id", "content_id"], "left_anti").select("user_id", "content_id", "generated_by")


cte("open_unseen", """
SELECT user_id, content_id, CASE WHEN min(p) = 0 THEN 'semantic' ELSE 'tag' END AS generated_by FROM (
  SELECT t.user_id, v.content_id, 0 AS p, row_number() OVER (PARTITION BY t.user_id ORDER BY list_cosine_similarity(t.v, v.v) DESC, v.content_id) AS rn
  FROM taste t CROSS JOIN vec v WHERE NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = t.user_id AND s.content_id = v.content_id)
  UNION ALL
  SELECT user_id, content_id, 1, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, content_id) FROM (
    SELECT user_id, content_id FROM (SELECT DISTINCT user_id, nkey FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, key) AS kr FROM aff_keys) WHERE kr <= 20)
    JOIN (SELECT DISTINCT content_id, nkey FROM ctag_keys) USING (nkey)) x
  WHERE NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = x.user_id AND s.content_id = x.content_id) GROUP BY user_id, content_id)
WHERE rn <= 30 GROUP BY user_id, content_id
""")


@query("open_candidates_unseen", "SELECT user_id, content_id, generated_by FROM open_unseen")
def open_candidates_unseen(spark, sf_dir):
    """The other setting of ``pool_before_seen``: the cut comes after the seen items have left."""
    w = RecWorld(spark, sf_dir, stored=True)
    pool = rc.open_pool(w.open_requests.select("user_id"), w.catalogue, w.model, replace(CFG, pool_before_seen=False))
    return pool.select("user_id", "content_id", "generated_by")


@query("catalogue_sample", """
SELECT user_id, content_id, rn AS draw FROM (
  SELECT u.user_id, c.content_id, CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY md5(c.content_id || ':7'), c.content_id) AS INTEGER) AS rn
  FROM (SELECT DISTINCT user_id FROM iev) u CROSS JOIN cont c
  WHERE NOT EXISTS (SELECT 1 FROM seen_items s WHERE s.user_id = u.user_id AND s.content_id = c.content_id)) WHERE rn <= 5
""")
def catalogue_sample(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    users = w.events.select("user_id").distinct()
    return cg.sample_outside(users, w.model.seen, cg.sample_order(w.contents, 7), 5, key="user_id")


@query("candidate_features", """
SELECT user_id AS request_id, content_id, round(semantic, 6) AS semantic, round(affinity, 6) AS affinity, round(least(tag, 1), 6) AS tag,
       round(recency, 6) AS recency, round(least(aversion, 1), 6) AS aversion, round(score, 6) + 0.0 AS final_score FROM fused
""")
def candidate_features(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    pool, _ = rc.candidate_pool(w.open_requests, w.catalogue, w.model, CFG)
    fused = fuse(score_candidates(pool, w.catalogue, w.model, CFG), CFG)
    return fused.selectExpr(
        "request_id", "content_id", *r6("semantic", "affinity", "tag", "recency", "aversion", "final_score"))


@query("recommendations", """
SELECT user_id AS request_id, CAST(rank AS INTEGER) AS rank, content_id, role, round(score, 6) + 0.0 AS relevance_score FROM rec_items
""")
def recommendations(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    items = rc.recommend(w.open_requests, w.catalogue, w.model, CFG).items
    return items.selectExpr("request_id", "rank", "content_id", "role", *r6("relevance_score"))


@query("served_lists_log", """
SELECT i.user_id AS request_id, CAST(rank AS INTEGER) AS rank, i.content_id, role, round(i.score, 6) + 0.0 AS relevance_score, 'warm' AS strategy, false AS cold_start,
  CASE WHEN role = 'target' THEN concat_ws(';', printf('%.4f', round(semantic, 4) + 0.0), printf('%.4f', round(affinity, 4) + 0.0), printf('%.4f', round(least(tag, 1), 4) + 0.0),
    printf('%.4f', round(recency, 4) + 0.0), printf('%.4f', round(least(aversion, 1), 4) + 0.0), '0.0000') ELSE '' END AS features,
  round(CASE WHEN role = 'target' THEN 0.45 * least(tag, 1) END, 6) AS tag_part
FROM rec_items i LEFT JOIN fused f ON f.user_id = i.user_id AND f.content_id = i.content_id AND role = 'target'
""")
def served_lists_log(spark, sf_dir):
    """What the recommender serves goes to the served log as it is, scores and features too, and comes back item by item."""
    w = RecWorld(spark, sf_dir, stored=True)
    recs = rc.recommend(w.open_requests, w.catalogue, w.model, CFG)
    base = f"{run_folder(spark)}/served-{uuid.uuid4().hex}"
    logs.append_served(rc.served_rows(recs, "TIMESTAMP'2024-01-31 00:00:00'"), base, batch="one")
    served = logs.read_served(spark, base)
    items = served.selectExpr("request_id", "strategy", "cold_start", "inline(items)")
    features = "array_join(transform(features, x -> format_string('%.4f', round(x, 4) + 0D)), ';')"
    return items.selectExpr("request_id", "rank", "id AS content_id", "role", "round(relevance_score, 6) + 0D AS relevance_score", "strategy", "cold_start",
                            f"{features} AS features", "round(IF(role = 'target', breakdown['tag'], NULL), 6) AS tag_part")


def _again(name: str) -> str:
    """The same hits without leaving out what the visitor has seen."""
    return re.sub(r"NOT EXISTS \(SELECT 1 FROM seen_items s WHERE [^)]*\)", "true", CTES[name])


def _for_bound(name: str) -> str:
    """A step of the open requests, for the constrained ones."""
    text = CTES[name]
    for step in ("open_cand", "cand_scores", "fused", "mmr_walk", "mmr_list"):
        text = re.sub(rf"\b{step}\b", f"bound_{step}", text)
    return text


for _name in ("filter_hits", "geo_hits", "both_hits"):
    cte(f"again_{_name}", _again(_name))
_ALL_HITS = """
SELECT user_id, content_id FROM {0}filter_hits JOIN reqs USING (user_id) WHERE lat IS NULL
UNION ALL SELECT user_id, content_id FROM {0}geo_hits JOIN reqs USING (user_id) WHERE value IS NULL
UNION ALL SELECT user_id, content_id FROM {0}both_hits
"""
cte("bound_fresh", _ALL_HITS.format(""))
cte("bound_again", _ALL_HITS.format("again_"))
cte("bound_open_cand", """
SELECT user_id, content_id FROM bound_fresh
UNION ALL SELECT user_id, content_id FROM bound_again WHERE user_id NOT IN (SELECT user_id FROM bound_fresh)
""")
cte("bound_cand_scores", _for_bound("cand_scores"))
cte("bound_fused", """
SELECT s.*, CAST(0.20 AS DOUBLE) * semantic + CAST(0.10 AS DOUBLE) * affinity + CAST(0.45 AS DOUBLE) * least(tag, 1)
        + CAST(0.05 AS DOUBLE) * recency + CAST(-0.30 AS DOUBLE) * least(aversion, 1)
        + CASE WHEN r.lat IS NULL THEN 0 ELSE CAST(0.20 AS DOUBLE) * exp(-2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - r.lat) / 2), 2)
           + cos(radians(r.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - r.lon) / 2), 2)))) / 300) END AS score
FROM bound_cand_scores s JOIN reqs r USING (user_id) JOIN cont c ON c.content_id = s.content_id
""")
cte("bound_mmr_walk", _for_bound("mmr_walk"))
cte("bound_mmr_list", _for_bound("mmr_list"))
cte("bound_distractor", """
SELECT f.user_id, arg_min(f.content_id, (score, f.content_id)) AS content_id, min(score) AS score,
       least(CASE WHEN CAST('0x' || substr(md5(f.user_id || ':slot:0'), 1, 6) AS INT) % 2 = 0 THEN 3 ELSE 4 END, any_value(l.n) + 1) AS slot
FROM bound_fused f JOIN (SELECT user_id, count(*) AS n FROM bound_mmr_list GROUP BY user_id) l ON l.user_id = f.user_id
WHERE NOT EXISTS (SELECT 1 FROM bound_mmr_list s WHERE s.user_id = f.user_id AND s.content_id = f.content_id) GROUP BY f.user_id
""")


@query("constrained_recommendations", """
SELECT l.user_id AS request_id, CAST(l.rank + CASE WHEN l.rank >= d.slot THEN 1 ELSE 0 END AS INTEGER) AS rank, l.content_id, 'target' AS role, round(f.score, 6) + 0.0 AS relevance_score
FROM bound_mmr_list l JOIN bound_fused f ON f.user_id = l.user_id AND f.content_id = l.content_id LEFT JOIN bound_distractor d ON d.user_id = l.user_id
UNION ALL
SELECT user_id, CAST(slot AS INTEGER), content_id, 'distractor', round(score, 6) + 0.0 FROM bound_distractor
""")
def constrained_recommendations(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    items = rc.recommend(w.requests.filter(rc.CONSTRAINED), w.catalogue, w.model, CFG).items
    return items.selectExpr("request_id", "rank", "content_id", "role", *r6("relevance_score"))


@query("recommendation_diagnostics", """
SELECT u.user_id AS request_id, 'warm' AS strategy, (SELECT count(DISTINCT content_id) FROM (SELECT * FROM sem_pool UNION ALL SELECT * FROM tag_pool) p WHERE p.user_id = u.user_id) AS pool_size,
  (SELECT count(*) FROM open_cand c WHERE c.user_id = u.user_id) AS scored FROM (SELECT DISTINCT user_id FROM taste) u
""")
def recommendation_diagnostics(spark, sf_dir):
    w = RecWorld(spark, sf_dir, stored=True)
    _, info = rc.candidate_pool(w.open_requests, w.catalogue, w.model, CFG)
    return info.select("request_id", "strategy", "pool_size", "scored")


@query("similar_items", """
SELECT item_id, content_id, round(score, 6) + 0.0 AS score FROM (
  SELECT a.content_id AS item_id, b.content_id, list_cosine_similarity(a.v, b.v) AS score,
         row_number() OVER (PARTITION BY a.content_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.content_id) AS rn
  FROM vec a JOIN vec b ON a.content_id <> b.content_id) WHERE rn <= 5
""")
def similar_items(spark, sf_dir):
    v = RecWorld(spark, sf_dir).vectors
    hits = nearest(v.selectExpr("content_id AS qid", "vec AS qvec", "1 AS extra"), v, 5).filter("qid <> content_id")
    best = top_k(hits.drop("rank"), ["qid"], [F.desc("score"), F.col("content_id")], 5)
    return best.selectExpr("qid AS item_id", "content_id", *r6("score"))
