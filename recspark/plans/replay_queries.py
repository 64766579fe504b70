"""Queries of the temporal replay."""

from __future__ import annotations

from recspark.operators import bandit as bd
from recspark.operators.replay import replay_samples
from recspark.plans.oracle import cte
from recspark.plans.recommend_queries import RecWorld
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import CFG

cte("rviews", "SELECT user_id, event_id, content_id, ts, dwell, end_reason FROM iev WHERE event = 'CONTENT_VIEW_ENDED'")
cte("rhist", """
SELECT v.user_id, v.event_id, h.content_id, any_value(v.ts) AS now, count(*) AS n, max(h.dwell) AS dwell, arg_max(h.end_reason, (h.ts, h.event_id)) AS end_reason, max(h.ts) AS last_ts
FROM rviews v JOIN rviews h ON h.user_id = v.user_id AND (h.ts, h.event_id) < (v.ts, v.event_id) GROUP BY 1, 2, 3
""")
cte("rstate", """
SELECT *, CASE WHEN s >= 0.30 THEN 'p' WHEN s <= -0.05 THEN 'n' ELSE 'o' END AS o, pow(0.5, (epoch_us(now) - epoch_us(last_ts)) / 86400e6 / 14.0) AS decay FROM (
  SELECT h.*, 0.4 * (CASE WHEN dwell <= 0 THEN 0 WHEN est <= 0 THEN 1 ELSE least(dwell / est, 2.0) / 2.0 END)
    + 0.3 * (CASE end_reason WHEN 'next_button' THEN 1.0 WHEN 'link' THEN 0.6 ELSE -0.5 END) + 0.2 * (1 - exp(-n / 2.0)) AS s
  FROM (SELECT h.*, c.word_count / CAST(4.2 AS DOUBLE) + CASE WHEN c.has_image THEN CAST(1.3 AS DOUBLE) ELSE 0 END AS est FROM rhist h JOIN cont c USING (content_id)) h)
""")
cte("rkeys", """
SELECT user_id, event_id, nkey, sum(CASE WHEN o = 'p' THEN s * decay * weight ELSE 0 END) AS a, sum(CASE WHEN o = 'n' THEN abs(s) * decay * weight ELSE 0 END) AS b
FROM rstate JOIN ctag_keys USING (content_id) WHERE nkey NOT LIKE 'place_where.camp_areas%' GROUP BY 1, 2, 3
""")
cte("rtaste", """
SELECT user_id, event_id, list(x ORDER BY i) AS v FROM (
  SELECT user_id, event_id, i, sum(s * decay * x) AS x FROM (SELECT r.*, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM rstate r JOIN vec v USING (content_id) WHERE o = 'p') GROUP BY 1, 2, 3) GROUP BY 1, 2
""")

cte("raffinity", """
SELECT user_id, event_id, max(CASE WHEN v.v IS NOT NULL THEN s * decay * (list_cosine_similarity(v.v, q.v) + 1) / 2 END) / max(s * decay) AS affinity
FROM rstate r JOIN (SELECT user_id, event_id, content_id AS viewed FROM rviews) USING (user_id, event_id)
JOIN vec q ON q.content_id = viewed LEFT JOIN vec v ON v.content_id = r.content_id WHERE o = 'p' GROUP BY 1, 2
""")


cte("replay_rows", """
SELECT v.user_id, v.event_id, v.content_id,
  coalesce((SELECT sum(k.a * t.weight) FROM rkeys k JOIN ctag_keys t USING (nkey) WHERE k.user_id = v.user_id AND k.event_id = v.event_id AND t.content_id = v.content_id)
     / nullif((SELECT sum(a) FROM rkeys k WHERE k.user_id = v.user_id AND k.event_id = v.event_id), 0), 0) AS tag,
  coalesce((SELECT sum(k.b * t.weight) FROM rkeys k JOIN ctag_keys t USING (nkey) WHERE k.user_id = v.user_id AND k.event_id = v.event_id AND t.content_id = v.content_id)
     / nullif((SELECT sum(b) FROM rkeys k WHERE k.user_id = v.user_id AND k.event_id = v.event_id), 0), 0) AS aversion,
  coalesce((list_cosine_similarity(t.v, cv.v) + 1) / 2, 0) AS semantic, coalesce((list_cosine_similarity(pv.v, cv.v) + 1) / 2, 0) AS recency,
  coalesce(a.affinity, 0) AS affinity,
  0.4 * (CASE WHEN v.dwell <= 0 THEN 0 WHEN c.word_count = 0 AND NOT c.has_image THEN 1 ELSE least(v.dwell / (c.word_count / CAST(4.2 AS DOUBLE) + CASE WHEN c.has_image THEN CAST(1.3 AS DOUBLE) ELSE 0 END), 2.0) / 2.0 END)
    + 0.3 * (CASE v.end_reason WHEN 'next_button' THEN 1.0 WHEN 'link' THEN 0.6 ELSE -0.5 END) + 0.2 * (1 - exp(CAST(-0.5 AS DOUBLE))) AS reward
FROM (SELECT *, lag(content_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM rviews) v JOIN cont c ON c.content_id = v.content_id JOIN vec cv ON cv.content_id = v.content_id
LEFT JOIN vec pv ON pv.content_id = v.prev LEFT JOIN rtaste t ON t.user_id = v.user_id AND t.event_id = v.event_id
LEFT JOIN raffinity a ON a.user_id = v.user_id AND a.event_id = v.event_id
""")
SCORES = ("tag", "aversion", "semantic", "recency", "affinity", "reward")


def _samples(spark, sf_dir):
    w = RecWorld(spark, sf_dir)
    views = w.events.filter("event = 'CONTENT_VIEW_ENDED'").selectExpr(
        "user_id", "event_id", "content_id", "ts", "dwell_seconds", "end_reason", "1 AS visits")
    return replay_samples(views, w.catalogue, CFG)


@query("replay_features", f"SELECT user_id, event_id, content_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)} FROM replay_rows")
def replay_features(spark, sf_dir):
    return _samples(spark, sf_dir).selectExpr("user_id", "event_id", "content_id", *r6(*SCORES))


@query("replay_training", """
SELECT i, j, round(sum(0.5 * x[i] * x[j]) + CASE WHEN i = j THEN 1 ELSE 0 END, 4) AS a, round(sum(0.5 * reward * x[i]) + any_value([0.20, 0.10, 0.45, 0.05, -0.30, 0.20][i]), 4) AS b, count(*) AS n
FROM (SELECT [semantic, affinity, tag, recency, aversion, 0] AS x, reward FROM replay_rows), range(1, 7) r1(i), range(1, 7) r2(j) GROUP BY i, j
""")
def replay_training(spark, sf_dir):
    """The policy's sums after foreign sessions, replayed at half weight over the prior."""
    state = bd.train(_samples(spark, sf_dir), CFG, weight="0.5D")
    cells = state.selectExpr("posexplode(a) AS (at, a)", "b", "n_updates AS n")
    return cells.selectExpr("CAST(at div 6 + 1 AS BIGINT) AS i", "CAST(at % 6 + 1 AS BIGINT) AS j", "round(a, 4) AS a", "round(get(b, CAST(at div 6 AS INT)), 4) AS b", "n")
