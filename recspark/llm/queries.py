"""Registered queries of the operators and their DuckDB twins."""

from __future__ import annotations

from recspark.llm.chat_format import op1_chat_format
from recspark.llm.decontaminate import op5_benchmark_decontamination
from recspark.llm.importance import op13_importance_resampling
from recspark.llm.language_id import op9_language_id
from recspark.llm.licenses import op6_license_scan
from recspark.llm.repair import op12_conversation_repair
from recspark.llm.repeats import op2_suffix_array_dedup
from recspark.llm.sentencepiece_codec import op7_sentencepiece
from recspark.llm.simhash import op8_simhash_dedup
from recspark.llm.token_counts import op10_token_counts
from recspark.llm.topk import op4_exact_topk
from recspark.llm.toxicity import op3_toxicity
from recspark.llm.twins import REPAIR_SQL, RESAMPLING_SQL, URL_SQL, WORDS
from recspark.llm.url_filter import op11_url_filter

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_exact_topk": op4_exact_topk,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
    "op11_url_filter": op11_url_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_importance_resampling": op13_importance_resampling,
}

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS win FROM (
  SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT row_id, i, size, list_slice(w, i, i + size - 1) AS win FROM (
  SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT row_id, i, dw.size, item FROM dw JOIN bw ON dw.win = bw.win),
c AS (SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY row_id),
t AS (SELECT row_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM h) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN t USING (row_id)
"""

TOPK_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op4_exact_topk": TOPK_SQL,
    "op5_benchmark_decontamination": DECONTAMINATION_SQL,
}

CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS said FROM conversations),
p AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
v AS (SELECT t.conv_id, speaker, coalesce(CAST(floor(turn / 256.0) AS BIGINT), -1) AS part, turn, who, said,
  concat('<|im_start|>', CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant'
    ELSE concat('user name=', regexp_replace(who, '[\\s<>|]+', '_', 'g')) END, chr(10)) AS head,
  concat(replace(said, '<|im_', '<| im_'), '<|im_end|>') AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (SELECT *, length(head) + coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, who, said
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM v)
SELECT conv_id, speaker, part, count(*) AS n_turns,
  string_agg(concat(head, body, chr(10)), '' ORDER BY turn NULLS FIRST, who, said) AS rendered,
  coalesce(string_agg(CASE WHEN who = speaker THEN concat(CAST(begins AS BIGINT), ':', CAST(begins + length(body) AS BIGINT)) END, ',' ORDER BY turn NULLS FIRST, who, said), '') AS mask
FROM s GROUP BY conv_id, speaker, part
"""
ORACLES["op1_chat_format"] = CHAT_SQL
ORACLES["op13_importance_resampling"] = RESAMPLING_SQL
ORACLES["op11_url_filter"] = URL_SQL
ORACLES["op12_conversation_repair"] = REPAIR_SQL
