"""DuckDB twins of the registered queries, assembled from shared named sub-queries."""

from __future__ import annotations

import re

# name -> SELECT text. A text may use the names above it; ``with_ctes`` pulls in what it needs.
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str, inside: str = "") -> None:
        for name in CTES:
            if name != inside and name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name], name)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    walks = [n for n in needed if re.search(rf"\b{n}\b", CTES[n])]
    body = ",\n".join(f"{n} AS {'' if n in walks else 'MATERIALIZED '}({CTES[n]})" for n in needed)
    return f"WITH {'RECURSIVE ' if walks else ''}{body}\n{sql.strip()}"


NOW = "TIMESTAMP '2024-01-31 00:00:00'"

cte("ev_kinds", """
SELECT event_id, user_id, ts, value, event_type,
       CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
       CASE WHEN event_type = 'view' THEN 'CONTENT_VIEW_STARTED'
            WHEN event_type IN ('click','purchase','error') THEN 'CONTENT_VIEW_ENDED'
            WHEN event_id % 8 = 1 THEN 'SURVEY_SUBMITTED'
            WHEN event_id % 8 = 2 THEN 'SURVEY_PRESENTED'
            WHEN event_id % 8 = 3 THEN 'SURVEY_DISMISSED'
            WHEN event_id % 8 = 4 THEN 'SESSION_STARTED'
            WHEN event_id % 8 = 5 THEN 'SESSION_ENDED'
            WHEN event_id % 8 = 6 THEN 'CONTENT_LOOKUP'
            ELSE 'IDENTIFY' END AS event
FROM events
""")
cte("iev", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, user_id AS uid, ts, event, event_type, k,
       CASE WHEN event_type <> 'signup' THEN CAST(k AS VARCHAR) END AS content_id,
       CASE WHEN event = 'CONTENT_VIEW_ENDED' THEN value END AS dwell,
       CASE event_type WHEN 'click' THEN 'next_button' WHEN 'purchase' THEN 'link' WHEN 'error' THEN 'abandon' END AS end_reason,
       CASE WHEN event = 'CONTENT_VIEW_ENDED' AND event_id % 10 = 0
            THEN CAST((event_id // 10) % 5 + 1 AS DOUBLE) END AS rating
FROM ev_kinds
""")
cte("cont", """
SELECT CAST(e.vec_id AS VARCHAR) AS content_id, e.vec_id, e.label, d.text,
       CASE WHEN d.text IS NULL THEN 0
            ELSE len(string_split_regex(trim(d.text, ' '), '\\s+')) END AS word_count,
       e.vec_id % 3 = 0 AS has_image,
       52.75 + (e.vec_id % 100) * CAST(0.0005 AS DOUBLE) AS lat,
       CAST(9.90 AS DOUBLE) + (e.vec_id // 100) * CAST(0.0005 AS DOUBLE) AS lon,
       1940 + e.vec_id % 6 AS year
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
""")
cte("ctags", """
SELECT content_id, 0 AS pos, 'theme_what' AS facet, 'label_' || label AS label, CAST(1.0 AS DOUBLE) AS weight FROM cont
UNION ALL SELECT content_id, 1, 'theme_how.type_of_stores', 'Store_' || (vec_id % 4), CAST(0.5 AS DOUBLE) FROM cont
UNION ALL SELECT content_id, 2, 'place_where.camp_areas', 'AiARLocationBarrack' || (vec_id % 7), CAST(1.0 AS DOUBLE) FROM cont WHERE vec_id % 5 = 0
UNION ALL SELECT content_id, 3, 'person_who.province_netherlands', 'Province-' || (vec_id % 12), CAST(0.7 AS DOUBLE) FROM cont WHERE vec_id % 6 = 0
""")
cte("views_agg", """
SELECT user_id, content_id,
       greatest(count(*) FILTER (event = 'CONTENT_VIEW_STARTED'), 1) AS visits,
       coalesce(max(dwell), greatest((epoch_us(max(ts) FILTER (event = 'CONTENT_VIEW_ENDED'))
         - epoch_us(min(ts) FILTER (event = 'CONTENT_VIEW_STARTED'))) / 1e6, 0.0)) AS dwell,
       arg_max(end_reason, ts) FILTER (event = 'CONTENT_VIEW_ENDED') AS end_reason,
       max(ts) AS last_ts,
       arg_max(rating, ts) FILTER (rating IS NOT NULL) AS rating
FROM iev WHERE content_id IS NOT NULL GROUP BY user_id, content_id
""")
cte("scored_views", f"""
SELECT *, CASE WHEN strength >= 0.30 THEN 'positive' WHEN strength <= -0.05 THEN 'negative' ELSE 'neutral' END AS outcome
FROM (
  SELECT *, CAST(0.4 AS DOUBLE) * dratio
     + CAST(0.3 AS DOUBLE) * (CASE end_reason WHEN 'next_button' THEN 1.0 WHEN 'link' THEN 0.6 WHEN 'abandon' THEN -0.5 ELSE 0.0 END)
     + CAST(0.2 AS DOUBLE) * (1.0 - exp(-visits / 2.0))
     + CAST(0.1 AS DOUBLE) * coalesce((rating - 3.0) / 2.0, 0.0) AS strength,
     pow(0.5, greatest(epoch_us({NOW}) - epoch_us(last_ts), 0) / 86400e6 / 14.0) AS decay
  FROM (
    SELECT v.*, est, CASE WHEN dwell IS NULL OR dwell <= 0 THEN 0.0 WHEN est <= 0 THEN 1.0
                     ELSE least(dwell / est, 2.0) / 2.0 END AS dratio
    FROM (SELECT v.*, coalesce(c.word_count, 0) / CAST(4.2 AS DOUBLE)
                 + CASE WHEN coalesce(c.has_image, false) THEN CAST(1.3 AS DOUBLE) ELSE 0.0 END AS est
          FROM views_agg v LEFT JOIN cont c USING (content_id)) v
  )
)
""")
cte("pos_items", """
SELECT user_id, content_id, greatest(strength, 0.0) * decay AS weight, last_ts FROM scored_views WHERE outcome = 'positive'
""")
cte("neg_explicit", """
SELECT user_id, content_id, abs(strength) * decay AS weight FROM scored_views WHERE outcome = 'negative'
""")
cte("neg_soft", f"""
SELECT user_id, content_id,
       max(0.30 * pow(0.5, greatest(epoch_us({NOW}) - epoch_us(ts), 0) / 86400e6 / 14.0)) AS weight
FROM (SELECT user_id, ts, CAST(unnest([(k + 1) % 100, (k + 2) % 100]) AS VARCHAR) AS content_id
      FROM iev WHERE event = 'CONTENT_VIEW_STARTED') s
WHERE NOT EXISTS (SELECT 1 FROM views_agg v WHERE v.user_id = s.user_id AND v.content_id = s.content_id)
GROUP BY user_id, content_id
""")
cte("neg_items", """
SELECT user_id, content_id, max(weight) AS weight
FROM (SELECT * FROM neg_explicit UNION ALL SELECT * FROM neg_soft) GROUP BY user_id, content_id
""")
cte("identified", """
SELECT *, ['18_24','25_34','35_44','55_64','65_plus'][uid % 5 + 1] AS age,
       ['female','male','Nonbinary','Vrouw.'][uid % 4 + 1] AS gender,
       ['dutch','germany','Spain','french','Poolse','new zealand'][uid % 6 + 1] AS nationality,
       'Province-' || (uid % 12) AS province,
       ['yes','nee','family','Ik weet het niet'][uid % 4 + 1] AS personal_connection,
       CASE WHEN uid % 3 = 0 THEN 'yes' ELSE 'no' END AS email_shared
FROM iev WHERE event = 'IDENTIFY'
""")
cte("survey_tags", """
SELECT user_id, 'person_who.age_group:' || (CASE age WHEN '65_plus' THEN 'elderly' ELSE 'age ' || replace(age, '_', '-') END) AS key, 0.5 AS amount FROM identified
UNION ALL SELECT user_id, 'person_who.gender_and_age:' || (CASE gender WHEN 'male' THEN 'Male' ELSE gender END), 0.3 FROM identified WHERE gender IN ('female','male')
UNION ALL SELECT user_id, 'person_who.city_village_country:From: ' ||
    (CASE nationality WHEN 'dutch' THEN 'Netherlands' WHEN 'germany' THEN 'Germany' WHEN 'french' THEN 'France' WHEN 'new zealand' THEN 'New Zealand' ELSE nationality END), 0.4 FROM identified
UNION ALL SELECT user_id, 'person_who.city_village_country:International', 0.3 FROM identified WHERE nationality NOT IN ('dutch','germany')
UNION ALL SELECT user_id, 'person_who.province_netherlands:' || province, 0.5 FROM identified
UNION ALL SELECT user_id, 'theme_what:label ' || (uid % 10), 1.0 FROM iev WHERE event = 'SURVEY_SUBMITTED'
""")
cte("demo_survey", """
SELECT DISTINCT user_id, age, gender, nationality, province, personal_connection, email_shared FROM identified
""")
cte("demo_provider", """
SELECT CAST(c_custkey AS VARCHAR) AS user_id, CAST(18 + c_custkey % 60 AS VARCHAR) AS age,
       CASE WHEN c_custkey % 2 = 0 THEN n_name END AS nationality
FROM customer JOIN nation ON n_nationkey = c_nationkey
""")
cte("demo", """
SELECT coalesce(p.user_id, s.user_id) AS user_id, coalesce(p.age, s.age) AS age, s.gender,
       coalesce(p.nationality, s.nationality) AS nationality, s.province, s.personal_connection, s.email_shared
FROM demo_survey s FULL OUTER JOIN demo_provider p ON p.user_id = s.user_id
""")
cte("demo_tags", """
SELECT user_id, 'person_who.age_group:' || CASE WHEN a < 18 THEN 'child' WHEN a <= 24 THEN 'age 18-24' WHEN a <= 34 THEN 'age 25-34'
   WHEN a <= 44 THEN 'age 35-44' WHEN a <= 54 THEN 'age 45-54' WHEN a <= 64 THEN 'age 55-64' ELSE 'elderly' END AS key, 0.5 AS amount
FROM (SELECT user_id, try_cast(age AS DOUBLE) AS a FROM demo) WHERE a IS NOT NULL
UNION ALL SELECT user_id, 'person_who.gender_and_age:' || upper(substr(gender,1,1)) || lower(substr(gender,2)), 0.3 FROM demo WHERE gender IS NOT NULL
UNION ALL SELECT user_id, 'person_who.city_village_country:From: ' || upper(substr(nationality,1,1)) || lower(substr(nationality,2)), 0.4 FROM demo WHERE nationality IS NOT NULL
UNION ALL SELECT user_id, 'person_who.province_netherlands:' || province, 0.5 FROM demo WHERE province IS NOT NULL
""")
cte("affinity", """
SELECT user_id, key, CASE WHEN max(total) OVER (PARTITION BY user_id) > 0 THEN total / max(total) OVER (PARTITION BY user_id) ELSE total END AS weight
FROM (SELECT user_id, lower(key) AS key, sum(CAST(amount AS DOUBLE)) AS total FROM (
        SELECT p.user_id, t.facet || ':' || t.label AS key, p.weight * t.weight AS amount
        FROM pos_items p JOIN ctags t USING (content_id) WHERE t.facet <> 'place_where.camp_areas'
        UNION ALL SELECT * FROM survey_tags UNION ALL SELECT * FROM demo_tags)
      GROUP BY user_id, lower(key))
""")
cte("aversion", """
SELECT user_id, key, CASE WHEN max(total) OVER (PARTITION BY user_id) > 0 THEN total / max(total) OVER (PARTITION BY user_id) ELSE total END AS weight
FROM (SELECT p.user_id, lower(t.facet || ':' || t.label) AS key, sum(p.weight * t.weight) AS total
      FROM neg_explicit p JOIN ctags t USING (content_id) WHERE t.facet <> 'place_where.camp_areas' GROUP BY 1, 2)
""")
cte("vec", "SELECT CAST(vec_id AS VARCHAR) AS content_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")
cte("taste_dims", """
SELECT user_id, i, sum(weight * x) AS x
FROM (SELECT user_id, weight, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pos_items JOIN vec USING (content_id))
GROUP BY user_id, i
""")
cte("taste", """
SELECT user_id, list_transform(list(x ORDER BY i), lambda y: y / sqrt(sum(x * x))) AS v FROM taste_dims GROUP BY user_id HAVING sum(x * x) > 0
""")
cte("recency", """
SELECT l.user_id, v.v FROM (SELECT user_id, arg_min(content_id, (-epoch_us(last_ts), content_id)) AS content_id FROM views_agg GROUP BY user_id) l
JOIN vec v USING (content_id)
""")
