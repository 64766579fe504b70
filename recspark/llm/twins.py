"""DuckDB twins of the operators whose queries SQL can say."""

from __future__ import annotations

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# CRC-32 of the UTF-8 bytes of a string, byte by byte over a table made from the polynomial.
CRC_TABLE = """crc(t) AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v FROM (SELECT unnest(range(0, 256)) AS i)))"""


def crc(text: str, table: str) -> str:
    """`table` is the expression of the list of 256 entries."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1]), 4294967295), 4294967295)"


RESAMPLING_SQL = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS row_id, doc_id, {WORDS.format("text")} AS w FROM documents),
b AS (SELECT {WORDS.format("text")} AS w FROM benchmark),
dw AS (SELECT row_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
k AS (SELECT word, {crc("word", "t")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw) CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN k USING (word) GROUP BY bucket),
o AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM s) + 10000 AS DOUBLE) AS of_s, CAST((SELECT coalesce(sum(n), 0) FROM t) + 10000 AS DOUBLE) AS of_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * of_s / ((CAST(s.n AS DOUBLE) + 1) * of_t))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket) CROSS JOIN o),
f AS (SELECT row_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY row_id),
x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN f USING (row_id)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM r
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM x WHERE n_features < 20
"""


def _levels(order: int) -> str:
    """Probabilities of the last characters of all grams of 1 to order + 1 characters."""
    out = []
    for size in range(1, order + 2):
        low = ("0.00390625::DOUBLE", "0.00390625::DOUBLE", "") if size == 1 else ("low.p_a", "low.p_r", f"JOIN p{size - 1} AS low ON low.g = right(m.g, {size - 1})")
        out.append(f"""m{size} AS (SELECT right(gram, {size}) AS g, left(right(gram, {size}), {size - 1}) AS context, sum(a) AS a, sum(r) AS r FROM grams GROUP BY 1, 2),
p{size} AS (SELECT m.g, (m.a + 2.0::DOUBLE * {low[0]}) / (c.a + 2.0::DOUBLE) AS p_a, (m.r + 2.0::DOUBLE * {low[1]}) / (c.r + 2.0::DOUBLE) AS p_r
  FROM m{size} AS m JOIN (SELECT context, sum(a) AS a, sum(r) AS r FROM m{size} GROUP BY context) AS c USING (context) {low[2]})""")
    return ",\n".join(out)


URL_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS row_id, page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  coalesce(md5(url)[1] IN ('0', '1', '2'), false) AS held FROM u),
rules AS (SELECT unnest([{{'given': 'allow', 'h': 'com', 'p': '/'}}, {{'given': 'block', 'h': 'example.com', 'p': '/en/'}}, {{'given': 'allow', 'h': 'www.example.com', 'p': '/en/'}},
  {{'given': 'block', 'h': 'net', 'p': '/es/'}}, {{'given': 'block', 'h': 'net', 'p': '/fr/'}}], recursive := true)),
f AS (SELECT row_id, max_by(h || p, length(h || p)) AS rule, max_by(given, length(h || p)) AS given
  FROM h JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row_id),
l AS (SELECT h.*, rule, given FROM h LEFT JOIN f USING (row_id)),
spots AS (SELECT row_id, substring(repeat(chr(2), 4) || coalesce(url, '') || chr(3), i, 5) AS gram,
  CAST(coalesce(given = 'allow' AND NOT held, false) AS INT) AS a, CAST(coalesce(given = 'block' AND NOT held, false) AS INT) AS r
  FROM (SELECT *, unnest(range(1, length(coalesce(url, '')) + 2)) AS i FROM l)),
grams AS (SELECT gram, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM spots GROUP BY gram),
{_levels(4)},
s AS (SELECT row_id, CAST(floor(CAST(sum(weight) AS DOUBLE) / count(*)) AS BIGINT) AS score
  FROM spots JOIN (SELECT g AS gram, CAST(floor(1000 * ln(p_a / p_r)) AS BIGINT) AS weight FROM p5) USING (gram) GROUP BY row_id),
o AS (SELECT greatest(least(score, 10000), -10000) AS v, count(*) FILTER (given = 'allow') AS a, count(*) FILTER (given = 'block') AS b
  FROM l JOIN s USING (row_id) WHERE held AND given IS NOT NULL GROUP BY 1),
w AS (SELECT v, sum(a) OVER () AS all_a, sum(b) OVER () AS all_b, sum(a) OVER (ORDER BY v DESC) AS right_a, sum(b) OVER (ORDER BY v) - b AS right_b,
  least(v, greatest(0, coalesce(lag(v) OVER (ORDER BY v) + 1, 0))) AS near FROM o),
c AS (SELECT near AS v FROM w WHERE all_a > 0 AND all_b > 0 ORDER BY CAST(right_a AS DOUBLE) / all_a + CAST(right_b AS DOUBLE) / all_b DESC, abs(near), near DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN score >= coalesce((SELECT v FROM c), 0) THEN 'allow' ELSE 'block' END) AS verdict, score
FROM l JOIN s USING (row_id)
"""


def _more(q: str, cost: str, audit: str, said: str | None) -> str:
    """State `q` (cost, audit, repaired turns) after one more edit; null where q is."""
    out = f"{q}.out" if said is None else f"list_append({q}.out, {said})"
    return f"CASE WHEN {q} IS NOT NULL THEN {{'cost': {q}.cost + {cost}, 'audit': {q}.audit || '{audit}', 'out': {out}}} END"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _unless(condition: str, state: str) -> str:
    return f"CASE WHEN {condition} THEN {state} END"


def _row_edits(source: str, initials: str, speaker: str, keeps: str) -> list[str]:
    """Keep and re-role from one state."""
    return [_unless(f"NOT void AND {keeps}", _more(source, "extra", "K", "role || ':' || text")),
            _unless("NOT void", _more(source, "3 + extra", "R", f"'{speaker}:' || text"))]


# Forward over the rows: of each state the cheapest way there, ties by the audit, with insertions before a row.
_USER = [e for q in ("s0", "s1", "w3") for e in _row_edits(q, "u", "user", "initial = 'u'")]
REPAIR_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
l AS (SELECT o.*, {crc("k", "v")} % 20 AS lot FROM o CROSS JOIN (SELECT t AS v FROM crc)),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(0, CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy FROM l WHERE lot <> 0),
p AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial, 'ua') AS pair FROM p),
r AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS void, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
x(conv_id, i, s0, s1, w2, w3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])}}, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, "out" VARCHAR[])),
    {{'cost': 3, 'audit': 'I', 'out': ['user:']}}, {{'cost': 6, 'audit': 'II', 'out': ['user:', 'assistant:']}} FROM t
  UNION ALL
  SELECT conv_id, i, s0, s1, w2, {_least("v3", _more("w2", "3", "I", "'assistant:'"))} FROM (
    SELECT conv_id, i, s0, s1, {_least("v2", *[_more(q, "3", "I", "'user:'") for q in ("s0", "s1", "v3")])} AS w2, v3 FROM (
      SELECT x.conv_id, r.i, {_more("s0", "4", "D", None)} AS s0,
        {_least(_more("s1", "4", "D", None), _unless("NOT void AND initial = 's'", _more("s0", "extra", "K", "role || ':' || text")))} AS s1,
        {_least(_more("w2", "4", "D", None), *_USER)} AS v2,
        {_least(_more("w3", "4", "D", None), *_row_edits("w2", "a", "assistant", "initial = 'a'"))} AS v3
      FROM x JOIN r ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = x.i + 1))),
e AS (SELECT x.conv_id, gaps, blank, duplicate, truncated, illegal, {_least("s0", "w3")} AS best FROM x JOIN t ON x.conv_id IS NOT DISTINCT FROM t.conv_id AND i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(best.cost AS BIGINT), 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
