"""Queries of personas, clusters, search, taxonomy and list evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from recspark.functions import survey as sv
from recspark.functions.text_vectors import text_vectors
from recspark.functions.vectors import cosine
from recspark.operators import clusters as cl
from recspark.operators import cohort as co
from recspark.operators import evaluation as ev
from recspark.operators import persona as pe
from recspark.operators import search as sr
from recspark.operators import sessions as se
from recspark.operators import signals as sg
from recspark.operators import taxonomy as tx
from recspark.plans import bindings as b
from recspark.plans import cohort_queries  # noqa: F401  twins here use its sub-queries
from recspark.plans.oracle import CTES, cte
from recspark.plans.recommend_queries import RecWorld
from recspark.plans.registry import ORACLES, query, r6
from recspark.plans.signal_queries import CFG, World
from recspark.session import materialize

cte("breadths", """
SELECT user_id, CASE WHEN themes > 0 THEN least((themes - 1) / 3.0, 1.0) ELSE 0 END AS breadth FROM (
  SELECT user_id, CASE WHEN count(*) FILTER (outcome = 'positive') > 0 THEN count(DISTINCT CASE WHEN outcome = 'positive' THEN label END) ELSE count(DISTINCT label) END AS themes
  FROM scored_views v JOIN cont c USING (content_id) GROUP BY user_id)
""")
cte("beh", """
SELECT s.user_id, count(*) AS n, count(*) FILTER (outcome = 'positive') AS np, round(avg(dratio), 4) AS dwell,
  round(avg(CASE WHEN end_reason = 'next_button' THEN 1.0 ELSE 0.0 END), 4) AS completion, round(avg(CASE WHEN outcome = 'positive' THEN 1.0 ELSE 0.0 END), 4) AS depth FROM scored_views s GROUP BY user_id
""")
cte("kinds", """
SELECT b.*, x.breadth, greatest(dwell, depth, 0.35) AS reach, greatest(0, 1 - greatest(n - 1, 0) / 6.0) AS few, least(n / 5.0, 1.0) AS many,
  (SELECT sum(weight) FILTER (key LIKE 'person_who%') / sum(weight) FROM affinity a WHERE a.user_id = b.user_id) AS ish,
  (SELECT sum(weight) FILTER (key LIKE 'theme_what%') / sum(weight) FROM affinity a WHERE a.user_id = b.user_id) AS csh,
  (SELECT coalesce(sum(CASE WHEN key LIKE 'theme_what%' OR key LIKE 'place_where%' THEN weight END), 0) FROM affinity a WHERE a.user_id = b.user_id) AS cog,
  (SELECT coalesce(sum(CASE WHEN key LIKE 'person_who%' THEN 0.5 * weight END), 0) FROM affinity a WHERE a.user_id = b.user_id)
     + CASE WHEN lower(coalesce(d.personal_connection, '')) IN ('yes', 'family') THEN 0.5 ELSE 0 END AS intro,
  CASE WHEN lower(coalesce(d.personal_connection, '')) = 'family' THEN 0.6 ELSE 0 END AS social
FROM beh b JOIN breadths x USING (user_id) LEFT JOIN demo d ON d.user_id = b.user_id
""")
cte("start4", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS c FROM (SELECT DISTINCT user_id FROM affinity ORDER BY user_id LIMIT 4)")
cte("cent4", "SELECT c AS cluster, key, weight FROM affinity JOIN start4 USING (user_id)")
cte("dist4", """
SELECT u.user_id, s.c AS cluster, greatest(u.xx - 2 * coalesce(dt.d, 0) + cc.cc, 0) AS d2
FROM (SELECT user_id, sum(weight * weight) AS xx FROM affinity GROUP BY user_id) u CROSS JOIN start4 s
JOIN (SELECT cluster, sum(weight * weight) AS cc FROM cent4 GROUP BY cluster) cc ON cc.cluster = s.c
LEFT JOIN (SELECT a.user_id, c.cluster, sum(a.weight * c.weight) AS d FROM affinity a JOIN cent4 c USING (key) GROUP BY 1, 2) dt ON dt.user_id = u.user_id AND dt.cluster = s.c
""")
cte("label4", "SELECT user_id, arg_min(cluster, (d2, cluster)) AS cluster FROM dist4 GROUP BY user_id")
_BUCKET = "0"
for _p in range(4):
    _BUCKET = f"(({_BUCKET} * {(1 << 32) % 64} + CAST('0x' || substr(h, {_p * 8 + 1}, 8) AS BIGINT)) % 64)"
cte("search_q", """
SELECT conv_id || ':' || turn AS query_id, text, CASE WHEN role = 'assistant' THEN 52.75 + (conv_id % 100) * CAST(0.0005 AS DOUBLE) END AS lat,
  CASE WHEN role = 'assistant' THEN CAST(9.90 AS DOUBLE) END AS lon, conv_id, turn, role FROM conversations
""")
cte("query_vec", f"""
SELECT query_id, list_transform(list(n ORDER BY i), lambda y: y / sqrt(list_sum(list_transform(list(n ORDER BY i), lambda z: z * z)))) AS v FROM (
  SELECT q.query_id, g.i, CAST(count(t.b) AS DOUBLE) AS n FROM search_q q CROSS JOIN range(0, 64) g(i) LEFT JOIN (
    SELECT query_id, {_BUCKET} AS b FROM (SELECT query_id, md5(tok) AS h FROM (SELECT query_id, unnest(string_split_regex(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), ' ')) AS tok FROM search_q) WHERE tok <> '')) t
  ON t.query_id = q.query_id AND t.b = g.i GROUP BY 1, 2) GROUP BY query_id
""")


cte("proj", """
SELECT user_id, item_id, (epoch_us(nx) - epoch_us(ts)) / 1e6 >= word_count / CAST(4.2 AS DOUBLE) + CASE WHEN has_image THEN CAST(1.3 AS DOUBLE) ELSE 0 END AS good FROM (
  SELECT user_id, content_id AS item_id, ts, event, lead(ts) OVER (PARTITION BY user_id, content_id ORDER BY ts, event_id) AS nx FROM iev WHERE content_id IS NOT NULL) p
JOIN cont c ON c.content_id = p.item_id WHERE event = 'CONTENT_VIEW_STARTED' AND nx IS NOT NULL
""")
cte("wish", """
SELECT user_id, list(2 * g - coalesce(b, g) ORDER BY i) AS v FROM (
  SELECT user_id, i, avg(x) FILTER (good) AS g, avg(x) FILTER (NOT good) AS b FROM (
    SELECT user_id, good, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM proj JOIN vec v ON v.content_id = proj.item_id) GROUP BY 1, 2) WHERE g IS NOT NULL GROUP BY user_id
""")


class InsightWorld(RecWorld):
    @property
    def points(self):
        return materialize(self.model.tag_affinity.select("user_id", "key", "weight"))

    @property
    def search_queries(self):
        return b.table(self.spark, self.sf_dir, "conversations").selectExpr(
            "concat(conv_id, ':', turn) AS query_id", "text", "IF(role = 'assistant', 52.75D + (conv_id % 100) * 0.0005D, NULL) AS lat",
            "IF(role = 'assistant', 9.90D, NULL) AS lon", "300D AS radius_m")


def _starts(points):
    return [r[0] for r in points.select("user_id").distinct().orderBy("user_id").limit(4).collect()]


PERSONA_SQL = """
SELECT user_id, n AS n_views, np AS n_positive, round(breadth, 6) AS breadth,
  CASE WHEN dwell >= 0.6 AND completion >= 0.5 THEN 'deep_reader' WHEN dwell >= 0.7 AND n <= 3 AND breadth < 0.5 THEN 'contemplative' WHEN completion >= 0.7 AND n >= 4 THEN 'completionist' WHEN dwell < 0.35 AND n >= 4 THEN 'skimmer' ELSE 'sampler' END AS engagement_style,
  CASE WHEN cog >= intro THEN 'cognitive' ELSE 'introspective' END AS experience_preference,
  ['Hobbyist', 'Explorer', 'Experience-Seeker', 'Recharger', 'Facilitator'][list_position(sc, list_max(sc))] AS visitor_type, round(list_reverse_sort(sc)[1] - list_reverse_sort(sc)[2], 6) AS confidence
FROM (SELECT *, [(1 - breadth) * reach * (0.4 + 0.6 * csh) * (0.4 + 0.6 * many), breadth * reach, breadth * (1 - least(dwell, completion)) * (0.4 + 0.6 * many), reach * (1 - breadth) * few * (0.4 + 0.6 * ish), social] AS sc FROM kinds)
"""
cte("persona_rows", PERSONA_SQL)


@query("personas", PERSONA_SQL)
def personas(spark, sf_dir):
    w = World(spark, sf_dir, stored=True)
    return pe.personas(w.model, w.content_tags).selectExpr(
        "user_id", "n_views", "n_positive", *r6("breadth", "confidence"), "engagement_style", "experience_preference", "visitor_type")


@query("interest_evidence", """
SELECT b.user_id, CAST(b.rn AS INTEGER) AS rank, split_part(b.key, ':', 1) AS facet, substr(b.key, strpos(b.key, ':') + 1) AS label, round(b.weight, 6) AS weight,
  coalesce((SELECT string_agg(content_id, '|' ORDER BY round(weight, 9) DESC, content_id) FROM (SELECT p.content_id, p.weight FROM pos_items p JOIN ctags t USING (content_id) WHERE p.user_id = b.user_id AND lower(t.facet || ':' || t.label) = b.key ORDER BY round(p.weight, 9) DESC, p.content_id LIMIT 5)), '') AS evidence
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, key) AS rn FROM affinity) b WHERE rn <= 5
""")
def interest_evidence(spark, sf_dir):
    w = World(spark, sf_dir, stored=True)
    rows = pe.interests(w.model.tag_affinity, w.model.positives, w.content_tags)
    return rows.selectExpr("user_id", "rank", "facet", "label", *r6("weight"), "array_join(evidence, '|') AS evidence")


@query("trajectory", """
SELECT user_id, CAST(rn AS INTEGER) AS rank, theme FROM (SELECT user_id, theme, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, content_id DESC) AS rn FROM (
  SELECT v.user_id, v.content_id, v.last_ts, 'label_' || c.label AS theme, lead('label_' || c.label) OVER (PARTITION BY v.user_id ORDER BY v.last_ts, v.content_id) AS newer FROM views_agg v JOIN cont c USING (content_id))
  WHERE newer IS NULL OR newer <> theme) WHERE rn <= 6
""")
def trajectory(spark, sf_dir):
    w = World(spark, sf_dir)
    return pe.trajectory(w.model.views, w.content_tags)


def _strongest(weights: str, items: str, n: int) -> str:
    """Labels of the n strongest keys with the number of items behind them, as one text."""
    return f"""
SELECT user_id, string_agg(label || CASE WHEN found > 0 THEN ' (' || least(found, 5) || ')' ELSE '' END, ', ' ORDER BY rn) AS pull, string_agg(label, ', ' ORDER BY rn) AS plain FROM (
  SELECT b.user_id, b.rn, substr(b.key, strpos(b.key, ':') + 1) AS label,
    (SELECT count(DISTINCT p.content_id) FROM {items} p JOIN ctags t USING (content_id) WHERE p.user_id = b.user_id AND lower(t.facet || ':' || t.label) = b.key) AS found
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 9) DESC, key) AS rn FROM {weights}) b WHERE rn <= {n}) GROUP BY user_id
"""


cte("pull_rows", _strongest("affinity", "pos_items", 3))
cte("avoid_rows", _strongest("aversion", "neg_items", 2))
cte("walk_rows", """
SELECT user_id, string_agg(theme, ' → ' ORDER BY rn) AS walk FROM (SELECT user_id, theme, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, content_id DESC) AS rn FROM (
  SELECT v.user_id, v.content_id, v.last_ts, 'label_' || c.label AS theme, lead('label_' || c.label) OVER (PARTITION BY v.user_id ORDER BY v.last_ts, v.content_id) AS newer FROM views_agg v JOIN cont c USING (content_id))
  WHERE newer IS NULL OR newer <> theme) WHERE rn <= 6 GROUP BY user_id
""")


@query("persona_summaries", """
SELECT user_id, CASE WHEN coalesce(a.pull, b.plain, walk) IS NULL
    THEN 'New visitor, no engagement yet. Recommendations start from any survey persona or demographics, then adapt as they read.' ELSE concat_ws(' ',
  CASE WHEN n_views > 0 THEN 'Engaged with ' || n_views || CASE WHEN n_views = 1 THEN ' story' ELSE ' stories' END
    || CASE WHEN n_positive + coalesce(n_neg, 0) > 0 THEN ': ' || concat_ws(', ', CASE WHEN n_positive > 0 THEN n_positive || ' held attention' END, CASE WHEN n_neg > 0 THEN n_neg || ' dismissed' END) ELSE '' END || '.' END,
  CASE WHEN n_views > 0 THEN 'Reads to about ' || CAST(round_even(k.dwell * 100, 0) AS INTEGER) || '% of the estimated time, finishing ' || CAST(round_even(k.completion * 100, 0) AS INTEGER) || '%.' END,
  'Strongest pull toward ' || a.pull || '.', 'Tends to avoid ' || b.plain || '.', 'Recent path: ' || walk || '.',
  CASE engagement_style WHEN 'deep_reader' THEN 'Reads stories closely, finishing what they start' WHEN 'completionist' THEN 'Works through many stories to completion'
    WHEN 'skimmer' THEN 'Skims widely, sampling many stories briefly' WHEN 'sampler' THEN 'Samples a range of stories at a moderate pace'
    WHEN 'contemplative' THEN 'Lingers on a few stories, reading slowly and reflectively' ELSE 'Has not yet shown a clear reading style' END
    || '; reads like ' || CASE WHEN lower(visitor_type[1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || lower(visitor_type) || '.') END AS summary
FROM persona_rows JOIN kinds k USING (user_id) LEFT JOIN pull_rows a USING (user_id) LEFT JOIN avoid_rows b USING (user_id) LEFT JOIN walk_rows USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n_neg FROM neg_items GROUP BY user_id) USING (user_id)
""")
def persona_summaries(spark, sf_dir):
    w = World(spark, sf_dir, stored=True)
    m, tags = w.model, w.content_tags
    return pe.verbalize(pe.personas(m, tags), pe.interests(m.tag_affinity, m.positives, tags),
                        pe.interests(m.tag_aversion, m.negatives, tags), pe.trajectory(m.signals, tags))


@query("cluster_assignment", "SELECT user_id, CAST(cluster AS INTEGER) AS cluster, (SELECT round(min(d2), 6) FROM dist4 d WHERE d.user_id = l.user_id) + 0.0 AS d2 FROM label4 l")
def cluster_assignment(spark, sf_dir):
    points = InsightWorld(spark, sf_dir).points
    return cl.assign(points, cl.centroids_of_users(points, _starts(points)), 4).selectExpr("user_id", "cluster", *r6("d2"))


@query("cluster_step", """
SELECT CAST(cluster AS INTEGER) AS cluster, key, round(sum(weight) / any_value(n), 6) AS weight FROM affinity JOIN label4 USING (user_id)
JOIN (SELECT cluster, count(*) AS n FROM label4 GROUP BY cluster) USING (cluster) GROUP BY cluster, key
""")
def cluster_step(spark, sf_dir):
    points = InsightWorld(spark, sf_dir).points
    moved = cl.lloyd_step(points, cl.centroids_of_users(points, _starts(points)), 4)
    return cl.long_centroids(moved).selectExpr("cluster", "key", *r6("weight"))


@query("soft_memberships", """
SELECT user_id, CAST(cluster AS INTEGER) AS cluster, round(CASE WHEN hits > 0 THEN (CASE WHEN d2 < 1e-24 THEN 1.0 / hits ELSE 0 END) ELSE (1 / d2) / tot END, 6) AS membership
FROM (SELECT *, count(*) FILTER (d2 < 1e-24) OVER (PARTITION BY user_id) AS hits, sum(CASE WHEN d2 > 0 THEN 1 / d2 END) OVER (PARTITION BY user_id) AS tot FROM dist4)
""")
def soft_memberships(spark, sf_dir):
    points = InsightWorld(spark, sf_dir).points
    soft = cl.memberships(points, cl.centroids_of_users(points, _starts(points)), 4)
    return soft.selectExpr("user_id", "posexplode(u) AS (cluster, membership)").selectExpr("user_id", "cluster", *r6("membership"))


@query("cluster_preferences", """
SELECT CAST(cluster AS INTEGER) AS cluster, 'content' AS kind, rn AS rank, content_id AS id, 'Item ' || content_id AS label, CAST(n AS DOUBLE) AS amount FROM (
  SELECT cluster, content_id, count(*) AS n, CAST(row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, content_id) AS INTEGER) AS rn FROM label4 JOIN pos_items USING (user_id) GROUP BY 1, 2) WHERE rn <= 5
UNION ALL SELECT CAST(cluster AS INTEGER), 'theme', rn, key, substr(key, strpos(key, ':') + 1), round(s, 6) FROM (
  SELECT cluster, key, sum(weight) AS s, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(sum(weight), 9) DESC, key) AS INTEGER) AS rn FROM label4 JOIN affinity USING (user_id) GROUP BY 1, 2) WHERE rn <= 6
""")
def cluster_preferences(spark, sf_dir):
    w = InsightWorld(spark, sf_dir, stored=True)
    points = w.points
    labels = cl.assign(points, cl.centroids_of_users(points, _starts(points)), 4)
    rows = co.cluster_preferences(labels.select("user_id", "cluster"), w.model.positives, w.model.tag_affinity, w.contents)
    return rows.selectExpr("cluster", "kind", "rank", "id", "label", *r6("amount"))


@query("visitor_profiles", """
SELECT coalesce(v.user_id, d.user_id) AS user_id, coalesce(anonymous, true) AS anonymous, coalesce(n_views, 0) AS n_views, coalesce(n_served, 0) AS n_served, coalesce(n_liked, 0) AS n_liked, coalesce(cold, true) AS cold, segment, feedback, demographics
FROM (SELECT coalesce(t.user_id, g.user_id) AS user_id, anonymous, n_views, n_served, n_liked, cold, segment FROM visitor_rows t
  FULL OUTER JOIN (SELECT user_id, 'Cluster ' || cluster AS segment FROM label4) g ON g.user_id = t.user_id) v
LEFT JOIN (SELECT user_id, string_agg(question || '=' || score, ';' ORDER BY question) AS feedback FROM fb GROUP BY user_id) f ON f.user_id = v.user_id
FULL OUTER JOIN (SELECT user_id, string_agg(field || '=' || value, ';' ORDER BY field) AS demographics FROM canon_rows GROUP BY user_id) d ON d.user_id = v.user_id
""")
def visitor_profiles(spark, sf_dir):
    """Every known visitor with cluster, feedback and demographics."""
    w = InsightWorld(spark, sf_dir, stored=True)
    points = w.points
    segments = cl.assign(points, cl.centroids_of_users(points, _starts(points)), 4).selectExpr("user_id", "concat('Cluster ', cluster) AS segment")
    rows = co.visitor_profiles(w.model, b.served(spark, sf_dir), segments, sv.feedback_scores(w.events), sg.demographic_values(w.model.demographics))
    text = "array_join(transform(map_entries({0}), e -> concat(e.key, '=', e.value)), ';') AS {0}"
    return rows.selectExpr("user_id", "anonymous", "n_views", "n_served", "n_liked", "cold", "segment", text.format("feedback"), text.format("demographics"))


@query("cluster_model")
def cluster_model(spark, sf_dir):
    points = InsightWorld(spark, sf_dir).points
    centroids, k = cl.kmeans(points, 4)
    labels = cl.assign(points, centroids, k)
    return cl.profiles(labels, centroids, k).selectExpr("cluster", "size", "falk_hint", *r6("breadth"))


ROUNDS = 3
for _r in range(1, ROUNDS + 1):
    _was, _now = ("4", f"4_{_r}") if _r == 1 else (f"4_{_r - 1}", f"4_{_r}")
    cte(f"cent{_now}", f"""
SELECT cluster, key, sum(weight) / any_value(n) AS weight FROM affinity JOIN label{_was} USING (user_id)
JOIN (SELECT cluster, count(*) AS n FROM label{_was} GROUP BY cluster) USING (cluster) GROUP BY cluster, key
UNION ALL SELECT cluster, key, weight FROM cent{_was} WHERE cluster NOT IN (SELECT cluster FROM label{_was})
""")
    cte(f"dist{_now}", re.sub(r"\bcent4\b", f"cent{_now}", CTES["dist4"]))
    cte(f"label{_now}", CTES["label4"].replace("dist4", f"dist{_now}"))


@query("cluster_rounds", f"SELECT user_id, CAST(cluster AS INTEGER) AS cluster FROM label4_{ROUNDS}")
def cluster_rounds(spark, sf_dir):
    """k-means from four given visitors, a few rounds that a twin can follow."""
    points = InsightWorld(spark, sf_dir).points
    centroids, k = cl.kmeans(points, 4, iters=ROUNDS, start=_starts(points))
    return cl.assign(points, centroids, k).select("user_id", "cluster")


cte("soft3_0", """
SELECT user_id, cluster, r / sum(r) OVER (PARTITION BY user_id) AS u FROM (
  SELECT user_id, j AS cluster, CAST('0x' || substr(md5(user_id || ':' || j || ':0'), 1, 8) AS BIGINT) / 4294967296 + 1e-6 AS r
  FROM (SELECT DISTINCT user_id FROM affinity), range(0, 3) g(j))
""")
for _r in range(1, ROUNDS + 1):
    cte(f"cent3_{_r}", f"""
SELECT cluster, key, sum(u * u * weight) / any_value(den) AS weight FROM affinity JOIN soft3_{_r - 1} USING (user_id)
JOIN (SELECT cluster, sum(u * u) AS den FROM soft3_{_r - 1} GROUP BY cluster) USING (cluster) GROUP BY cluster, key
""")
    cte(f"soft3_{_r}", f"""
SELECT user_id, cluster, (1 / d2) / sum(1 / d2) OVER (PARTITION BY user_id) AS u FROM (
  SELECT x.user_id, c.cluster, x.xx - 2 * sum(a.weight * coalesce(m.weight, 0)) + any_value(c.cc) AS d2
  FROM (SELECT user_id, sum(weight * weight) AS xx FROM affinity GROUP BY user_id) x
  CROSS JOIN (SELECT cluster, sum(weight * weight) AS cc FROM cent3_{_r} GROUP BY cluster) c
  JOIN affinity a ON a.user_id = x.user_id LEFT JOIN cent3_{_r} m ON m.cluster = c.cluster AND m.key = a.key GROUP BY x.user_id, c.cluster, x.xx)
""")


@query("fuzzy_rounds", f"SELECT user_id, CAST(cluster AS INTEGER) AS cluster, round(u, 6) AS membership FROM soft3_{ROUNDS}")
def fuzzy_rounds(spark, sf_dir):
    """Fuzzy c-means from seeded memberships, a few rounds that a twin can follow."""
    points = InsightWorld(spark, sf_dir).points
    centroids, c = cl.fuzzy_cmeans(points, 3, iters=ROUNDS)
    soft = cl.memberships(points, centroids, c)
    return soft.selectExpr("user_id", "posexplode(u) AS (cluster, membership)").selectExpr("user_id", "cluster", *r6("membership"))


def _both_clusterings(w):
    """k-means and fuzzy c-means after the same fixed rounds as cluster_rounds and fuzzy_rounds."""
    points = w.points
    hard_centroids, k = cl.kmeans(points, 4, iters=ROUNDS, start=_starts(points))
    soft_centroids, c = cl.fuzzy_cmeans(points, 3, iters=ROUNDS)
    return points, cl.assign(points, hard_centroids, k), hard_centroids, cl.memberships(points, soft_centroids, c)


cte("soft_best", f"SELECT user_id, arg_min(cluster, (-u, cluster)) AS dominant, max(u) AS strongest FROM soft3_{ROUNDS} GROUP BY user_id")
cte("cluster_cells", f"""
SELECT h.cluster, s.cluster AS soft_cluster, count(*) FILTER (s.cluster = dominant) AS n, sum(u) AS mass
FROM label4_{ROUNDS} h JOIN soft3_{ROUNDS} s USING (user_id) JOIN soft_best USING (user_id) GROUP BY 1, 2
""")


@query("cluster_comparison", f"""
SELECT user_id, CAST(cluster AS INTEGER) AS cluster, CAST(dominant AS INTEGER) AS dominant, round(strongest, 6) AS strongest, round(strongest, 6) < 0.65 AS split
FROM label4_{ROUNDS} JOIN soft_best USING (user_id)
""")
def cluster_comparison(spark, sf_dir):
    """Hard bucket and soft membership of every visitor side by side."""
    _, hard, _, soft = _both_clusterings(InsightWorld(spark, sf_dir))
    rows = cl.compare(hard, soft).withColumn("strongest", F.round("strongest", 6))
    return rows.selectExpr("user_id", "cluster", "dominant", "strongest", f"strongest < {cl.SPLIT_BELOW}D AS split")


cte("agree_pairs", """
SELECT (SELECT sum(n) FROM cluster_cells) AS v, (SELECT sum(n * (n - 1) / 2.0) FROM cluster_cells) AS together,
  (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM cluster_cells GROUP BY cluster)) AS a, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(n) AS n FROM cluster_cells GROUP BY soft_cluster)) AS b
""")


@query("cluster_agreement", """
SELECT CAST(v AS BIGINT) AS visitors, round((together - a * b / (v * (v - 1) / 2.0)) / ((a + b) / 2.0 - a * b / (v * (v - 1) / 2.0)), 6) AS adjusted_rand,
  round((SELECT sum(m) FROM (SELECT max(n) AS m FROM cluster_cells GROUP BY cluster)) / v, 6) AS purity,
  round((SELECT sum(m) / sum(t) FROM (SELECT max(mass) AS m, sum(mass) AS t FROM cluster_cells GROUP BY cluster)), 6) AS soft_overlap FROM agree_pairs
""")
def cluster_agreement(spark, sf_dir):
    _, hard, _, soft = _both_clusterings(InsightWorld(spark, sf_dir))
    return cl.agreement(cl.contingency(hard, soft)).selectExpr("visitors", *r6("adjusted_rand", "purity", "soft_overlap"))


@query("cluster_shared_tags", f"""
SELECT user_id, CAST(cluster AS INTEGER) AS cluster, CAST(rank AS INTEGER) AS rank, key FROM (
  SELECT a.user_id, l.cluster, a.key, row_number() OVER (PARTITION BY a.user_id ORDER BY round(least(a.weight, c.weight), 9) DESC, a.key) AS rank
  FROM affinity a JOIN label4_{ROUNDS} l USING (user_id) JOIN cent4_{ROUNDS} c ON c.cluster = l.cluster AND c.key = a.key WHERE a.weight > 0 AND c.weight > 0) WHERE rank <= 5
""")
def cluster_shared_tags(spark, sf_dir):
    """Why a visitor is in its cluster: the strongest tags it shares with it."""
    points, hard, centroids, _ = _both_clusterings(InsightWorld(spark, sf_dir))
    return cl.shared_tags(points, hard, centroids)


@query("cluster_features", """
SELECT user_id, key, round(weight, 6) AS weight FROM affinity JOIN (
  SELECT key FROM affinity GROUP BY key HAVING count(*) >= 3 ORDER BY count(*) DESC, key LIMIT 20) USING (key)
""")
def cluster_features(spark, sf_dir):
    """The points that clustering sees when rare keys are left out: the 20 most carried keys of at least three visitors."""
    return cl.feature_points(InsightWorld(spark, sf_dir).points, min_freq=3, max_features=20).selectExpr("user_id", "key", *r6("weight"))


@query("preview_models", """
SELECT 'affinity' AS kind, user_id, key, round(total / max(total) OVER (PARTITION BY user_id), 6) AS weight FROM (
  SELECT user_id, lower(key) AS key, sum(CAST(amount AS DOUBLE)) AS total FROM (
    SELECT * FROM survey_tags UNION ALL SELECT DISTINCT user_id, 'theme_what:label_' || (uid % 10), 2.0 FROM iev) GROUP BY 1, 2)
UNION ALL SELECT 'taste', user_id, CAST(i AS VARCHAR), round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id)), 6) + 0.0 FROM (
  SELECT user_id, i, sum(x) AS x FROM (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pos_items JOIN vec USING (content_id)) GROUP BY 1, 2)
UNION ALL SELECT 'seen', user_id, content_id, 1.0 FROM pos_items
""")
def preview_models(spark, sf_dir):
    """Models of described instead of observed visitors: answers, named tags and liked items."""
    w = InsightWorld(spark, sf_dir)
    given = sg.survey_events(w.events).selectExpr("user_id", "survey_answers AS answers")
    tags = w.events.select("user_id").distinct().selectExpr("user_id", "concat('theme_what:label_', CAST(user_id AS BIGINT) % 10) AS key", "2D AS amount")
    model = ev.PreviewModel(given, tags, w.model.positives.select("user_id", "content_id"), w.vectors)
    taste = model.taste.selectExpr("'taste' AS kind", "user_id", "posexplode(taste) AS (i, weight)").selectExpr("kind", "user_id", "CAST(i + 1 AS STRING) AS key", "weight")
    rows = model.tag_affinity.selectExpr("'affinity' AS kind", "user_id", "key", "weight").unionByName(taste).unionByName(model.seen.selectExpr("'seen' AS kind", "user_id", "content_id AS key", "1D AS weight"))
    return rows.selectExpr("kind", "user_id", "key", *r6("weight"))


@query("persona_evaluation")
def persona_evaluation(spark, sf_dir):
    """What described visitors are shown over the catalogue: openly, near a place and at a location tag."""
    w = InsightWorld(spark, sf_dir)
    scenarios = [{"name": "open"}, {"name": "near", "near_lat": 52.7505, "near_lon": 9.9, "geo_radius_m": 400}, {"name": "barrack", "filter": "AiARLocationBarrack0"}]
    likes = w.contents.limit(0).selectExpr("'x' AS user_id", "content_id")
    found = ev.evaluate_personas(ev.builtin_personas(spark), scenarios, w.catalogue, likes, CFG)
    return found.selectExpr("persona", "scenario", "strategy", "n_items", "n_targets", "distinct_tags", "distractor_present", *r6("avg_target_score", "intra_list_diversity"))


@query("fuzzy_cluster_model")
def fuzzy_cluster_model(spark, sf_dir):
    points = InsightWorld(spark, sf_dir).points
    centroids, c = cl.fuzzy_cmeans(points, 3)
    soft = cl.memberships(points, centroids, c)
    return soft.selectExpr("user_id", "dominant", "round(array_max(u), 6) AS strongest", "round(aggregate(u, 0D, (a, x) -> a + x), 6) AS total")


@query("text_vectors", "SELECT query_id, CAST(i - 1 AS INTEGER) AS dim, round(x, 6) AS value FROM (SELECT query_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM query_vec)")
def text_vector_query(spark, sf_dir):
    v = text_vectors(InsightWorld(spark, sf_dir).search_queries.selectExpr("query_id", "text"), 64, key="query_id")
    return v.selectExpr("query_id", "posexplode(vec) AS (dim, value)").selectExpr("query_id", "dim", *r6("value"))


@query("search_hits", """
SELECT query_id, 'vector' AS search_type, content_id, round(s, 6) + 0.0 AS score FROM (SELECT q.query_id, v.content_id, list_cosine_similarity(q.v, v.v) AS s,
    row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, v.v) DESC, v.content_id) AS rn FROM query_vec q JOIN search_q USING (query_id) CROSS JOIN vec v WHERE lat IS NULL) WHERE rn <= 5
UNION ALL
SELECT query_id, 'hybrid', content_id, round(s, 6) + 0.0 FROM (SELECT q.query_id, v.content_id, list_cosine_similarity(q.v, v.v) AS s,
    row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, v.v) DESC, v.content_id) AS rn FROM query_vec q JOIN search_q r USING (query_id)
    JOIN cont c ON r.lat IS NOT NULL AND 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - r.lon) / 2), 2)))) <= 300
    JOIN vec v ON v.content_id = c.content_id) WHERE rn <= 5
""")
def search_hits(spark, sf_dir):
    w = InsightWorld(spark, sf_dir)
    return sr.search(w.search_queries, w.contents, w.vectors).selectExpr("query_id", "search_type", "content_id", *r6("score"))


@query("preference_search", """
SELECT user_id, CAST(rn AS INTEGER) AS rank, content_id, round(s, 6) + 0.0 AS score FROM (
  SELECT w.user_id, v.content_id, list_cosine_similarity(w.v, v.v) AS s, row_number() OVER (PARTITION BY w.user_id ORDER BY list_cosine_similarity(w.v, v.v) DESC, v.content_id) AS rn
  FROM wish w CROSS JOIN vec v WHERE NOT EXISTS (SELECT 1 FROM proj p WHERE p.user_id = w.user_id AND p.item_id = v.content_id)) WHERE rn <= 5
""")
def preference_search(spark, sf_dir):
    w = InsightWorld(spark, sf_dir)
    raw = w.events.filter("content_id IS NOT NULL").selectExpr(
        "user_id", "content_id AS item_id", "event_id", "IF(event = 'CONTENT_VIEW_STARTED', 'start', 'end') AS event_type", "ts")
    return sr.preference_search(sr.projection(se.paired_dwell(raw), w.contents, CFG), w.vectors).selectExpr("user_id", "rank", "content_id", *r6("score"))


@query("projection", """
SELECT user_id, item_id, epoch_us(ts) AS start_us, round(est, 6) AS estimated_reading_time, (epoch_us(nx) - epoch_us(ts)) / 1e6 >= est AS is_successful FROM (
  SELECT p.*, c.word_count / CAST(4.2 AS DOUBLE) + CASE WHEN c.has_image THEN CAST(1.3 AS DOUBLE) ELSE 0 END AS est FROM (
    SELECT user_id, content_id AS item_id, ts, event, lead(ts) OVER (PARTITION BY user_id, content_id ORDER BY ts, event_id) AS nx FROM iev WHERE content_id IS NOT NULL) p
  JOIN cont c ON c.content_id = p.item_id) WHERE event = 'CONTENT_VIEW_STARTED' AND nx IS NOT NULL
""")
def projection(spark, sf_dir):
    w = InsightWorld(spark, sf_dir)
    raw = w.events.filter("content_id IS NOT NULL").selectExpr(
        "user_id", "content_id AS item_id", "event_id", "IF(event = 'CONTENT_VIEW_STARTED', 'start', 'end') AS event_type", "ts")
    rows = sr.projection(se.paired_dwell(raw), w.contents, CFG)
    return rows.selectExpr("user_id", "item_id", "unix_micros(start_ts) AS start_us", *r6("estimated_reading_time"), "is_successful")


@query("profile_texts", "SELECT user_id, age || '-year-old ' || gender || ' from ' || nationality || ', interested in content related to people from the same nationality and similar age.' AS text FROM demo")
def profile_texts(spark, sf_dir):
    return sr.profile_text(World(spark, sf_dir).model.demographics)


@query("facet_assignment", """
WITH t AS (SELECT CASE c_custkey % 8 WHEN 0 THEN n_name WHEN 1 THEN 'From: ' || n_name WHEN 2 THEN 'Age 25-34' WHEN 3 THEN 'Barrack ' || (c_custkey % 90) WHEN 4 THEN 'International'
   WHEN 5 THEN r_name WHEN 6 THEN 'AiARLocationBarrack' || (c_custkey % 9) ELSE c_mktsegment END AS tag, c_custkey % 8 AS k, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT tag, CASE k WHEN 1 THEN 'person_who.city_village_country' WHEN 2 THEN 'person_who.age_group' WHEN 3 THEN 'place_where.camp_areas' WHEN 4 THEN 'person_who.city_village_country' WHEN 6 THEN 'place_where.camp_areas' ELSE 'theme_what' END AS facet,
  CASE k WHEN 0 THEN 'subtag' WHEN 1 THEN 'prefix' WHEN 2 THEN 'pattern' WHEN 3 THEN 'pattern' WHEN 4 THEN 'rollup' WHEN 5 THEN 'exact' WHEN 6 THEN 'pattern' ELSE 'default' END AS source,
  CASE k WHEN 0 THEN lower(replace(r_name, '_', ' ')) END AS rollup, count(*) AS n FROM t GROUP BY ALL
""")
def facet_assignment(spark, sf_dir):
    n = b.table(spark, sf_dir, "nation").join(b.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    mains = n.selectExpr("struct(r_regionkey AS d, 0 AS i, 0 AS j) AS seq", "'main' AS kind", "'theme_what' AS dimension", "r_name AS parent", "r_name AS term").distinct()
    subs = n.selectExpr("struct(r_regionkey AS d, 1 AS i, n_nationkey AS j) AS seq", "'sub' AS kind", "'theme_what' AS dimension", "r_name AS parent", "n_name AS term")
    c = b.table(spark, sf_dir, "customer").join(n, F.expr("c_nationkey = n_nationkey"))
    tags = c.selectExpr(
        "CASE c_custkey % 8 WHEN 0 THEN n_name WHEN 1 THEN concat('From: ', n_name) WHEN 2 THEN 'Age 25-34' WHEN 3 THEN concat('Barrack ', c_custkey % 90) WHEN 4 THEN 'International' "
        "WHEN 5 THEN r_name WHEN 6 THEN concat('AiARLocationBarrack', c_custkey % 9) ELSE c_mktsegment END AS tag").groupBy("tag").agg(F.expr("count(*) AS n"))
    return tx.assign_facets(tags, tx.tag_index(mains.unionByName(subs))).select("tag", "facet", "source", "rollup", "n")


@query("taxonomy_audit", f"SELECT source, facet, count(*) AS tags FROM ({ORACLES['facet_assignment']}) GROUP BY source, facet")
def taxonomy_audit(spark, sf_dir):
    """How much of the tag vocabulary each rule classified."""
    return tx.audit(facet_assignment(spark, sf_dir))


@query("matched_tags", r"""
WITH toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents),
cnt AS (SELECT doc_id, t, count(*) AS n FROM toks WHERE length(t) > 2 GROUP BY 1, 2),
voc AS (SELECT DISTINCT CASE WHEN k = 1 THEN 'lang:' || t ELSE 'word:' || t END AS key, t AS label FROM (SELECT lower(role) AS t, 1 AS k FROM conversations UNION SELECT lower(r_name || ' ' || n_name), 2 FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'the other women', 3)),
sc AS (SELECT doc_id, key, sum(n * CASE WHEN list_contains(regexp_extract_all(label, '[a-z0-9]+'), t) THEN 2 ELSE 1 END) AS s FROM cnt JOIN voc ON contains(label, t) GROUP BY 1, 2)
SELECT doc_id AS id, key AS tag, round(s / max(s) OVER (PARTITION BY doc_id), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, key) AS rn FROM sc) WHERE rn <= 12
""")
def matched_tags(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text")
    roles = b.table(spark, sf_dir, "conversations").selectExpr("concat('lang:', lower(role)) AS key").distinct()
    n = b.table(spark, sf_dir, "nation").join(b.table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    names = n.selectExpr("lower(concat('word:', r_name, ' ', n_name)) AS key")
    extra = spark.range(1).selectExpr("'word:the other women' AS key")
    return ev.match_tags(docs, roles.unionByName(names).unionByName(extra)).selectExpr("id", "tag", *r6("weight"))


@query("list_metrics", """
SELECT request_id, count(*) AS n_items, count(*) FILTER (rank <> 3) AS n_targets, round(avg(CASE WHEN rank <> 3 THEN x[1] END), 6) AS avg_target_score, bool_or(rank = 3) AS distractor_present,
  (SELECT count(DISTINCT t.facet || ':' || t.label) FROM served_lines l JOIN ctags t USING (content_id) WHERE l.request_id = s.request_id) AS distinct_tags,
  round((SELECT avg(1 - list_cosine_similarity(va.v, vb.v)) FROM served_lines a JOIN vec va USING (content_id) JOIN served_lines b2 ON b2.request_id = a.request_id AND b2.content_id > a.content_id JOIN vec vb ON vb.content_id = b2.content_id WHERE a.request_id = s.request_id), 6) AS intra_list_diversity
FROM served_lines s GROUP BY request_id
""")
def list_metrics(spark, sf_dir):
    w = InsightWorld(spark, sf_dir)
    items = b.served_items(spark, sf_dir, {"role": b.SERVED_LINE["role"], "relevance_score": f"{b.FEATURES_SQL}[0]"})
    m = ev.list_metrics(items, w.catalogue)
    return m.selectExpr("request_id", "n_items", "n_targets", "distractor_present", "distinct_tags", *r6("avg_target_score", "intra_list_diversity"))


@query("facet_spread", "SELECT request_id, facet, count(*) AS n FROM served_lines JOIN ctags USING (content_id) GROUP BY 1, 2")
def facet_spread(spark, sf_dir):
    return ev.facet_spread(b.served_items(spark, sf_dir), World(spark, sf_dir).content_tags)


@query("relevance_report", """
SELECT source AS persona, count(*) AS n, round(avg(1 + 2 * quality + 2 * toxic), 6) AS mean_score, round(avg(CASE WHEN 1 + 2 * quality + 2 * toxic >= 4 THEN 1.0 ELSE 0 END), 6) AS share_relevant
FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)
""")
def relevance_report(spark, sf_dir):
    v = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return ev.relevance_report(v.selectExpr("source AS persona", "1 + 2 * quality + 2 * toxic AS score")).selectExpr(
        "persona", "n", *r6("mean_score", "share_relevant"))


@query("explained_lists", """
SELECT r.request_id, r.content_id, k.nkey, round(max(a.weight), 6) AS user_weight FROM (SELECT l.request_id, l.content_id, CAST(o_custkey AS VARCHAR) AS user_id FROM served_lines l JOIN orders ON CAST(o_orderkey AS VARCHAR) = l.request_id) r
JOIN ctag_keys k ON k.content_id = r.content_id JOIN aff_keys a ON a.user_id = r.user_id AND a.nkey = k.nkey GROUP BY 1, 2, 3
""")
def explained_lists(spark, sf_dir):
    w = InsightWorld(spark, sf_dir, stored=True)
    items = b.served_items(spark, sf_dir).join(b.served(spark, sf_dir).select("request_id", "user_id"), "request_id")
    return pe.explain_served(items, w.catalogue.tags_nkey, w.model.tag_affinity).selectExpr("request_id", "content_id", "nkey", *r6("user_weight"))


@query("text_shaping", """
SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short, length(regexp_replace(text, '(?i)\\b(the)', '<b>\\1</b>', 'g')) - length(text) AS marked FROM documents
""")
def text_shaping(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.selectExpr("doc_id", f"{sr.limit_text('text')} AS short", f"CAST(length({sr.highlight('text', "'the'")}) - length(text) AS BIGINT) AS marked")


@query("vector_cosines", """
SELECT a.vec_id AS left_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def vector_cosines(spark, sf_dir):
    v = b.table(spark, sf_dir, "embeddings").selectExpr("vec_id AS left_id", "CAST(embedding AS ARRAY<DOUBLE>) AS a")
    nxt = v.selectExpr("left_id - 1 AS left_id", "a AS b")
    return v.join(nxt, "left_id").selectExpr("left_id", f"{cosine('a', 'b')} AS cosine").selectExpr("left_id", *r6("cosine"))
