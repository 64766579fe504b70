"""Raw track / identify payloads (JSON text) to canonical interaction events.

Works on batch and streaming frames: one projection per row, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END_REASONS = ("next_button", "link", "close_button", "abandon")  # fixed values


def content_id_sql(raw: str) -> str:
    """First digit run of an id, else the id itself."""
    return f"coalesce(nullif(regexp_extract({raw}, '[0-9]+', 0), ''), {raw})"


def _text(variant: str, path: str) -> str:
    return f"nullif(try_variant_get({variant}, '{path}', 'string'), '')"


def _bare(variant: str, path: str) -> str:
    """A scalar as text; null when the path holds an object."""
    text = _text(variant, path)
    return f"IF(startswith({text}, '{{'), NULL, {text})"


def _values(x: str) -> str:
    """A variant answer as array<string>: lists stay lists, scalars become one element."""
    return f"coalesce(try_variant_get({x}, '$', 'array<string>'), array(try_variant_get({x}, '$', 'string')))"


def normalize_payloads(bronze: DataFrame, value: str = "value", ingest_ts: str = "ingest_ts") -> DataFrame:
    """Canonical events; rows without event or user are dropped.

    bronze: a JSON text column and the ingest time of its batch, which stands in for a
    missing or unreadable time (``ts_missing`` marks such rows).
    """
    others = [c for c in bronze.columns if c not in (value, ingest_ts)]
    parsed = bronze.selectExpr(*others, f"{value} AS _raw", f"{ingest_ts} AS _ingest", f"try_parse_json({value}) AS v")
    heads = parsed.selectExpr(
        *others, "_raw", "_ingest", "v",
        f"{_text('v', '$.event')} AS raw_event",
        f"coalesce({_text('v', '$.userId')}, {_text('v', '$.anonymousId')}) AS user_id",
        "try_variant_get(v, '$.type', 'string') AS type",
        "try_variant_get(v, '$.traits', 'map<string,variant>') AS traits",
        f"coalesce({_text('v', '$.timestamp')}, {_text('v', '$.sentAt')}) AS time_text",
        "try_variant_get(v, '$.properties.answers', 'array<variant>') AS answers",
        "try_variant_get(v, '$.properties.context.candidates', 'array<variant>') AS candidates",
        f"coalesce(try_variant_get(v, '$.properties.content.content_id', 'string'), {_bare('v', '$.properties.content')}) AS content",
    )
    kinds = heads.selectExpr(
        "*",
        "coalesce(type = 'identify', false) OR (coalesce(size(traits), 0) > 0 AND raw_event IS NULL) AS identify",
        "transform(coalesce(answers, array()), a -> struct(try_variant_get(a, '$.question_id', 'string') AS q, "
        "try_variant_get(a, '$.answer_value', 'variant') AS x, try_variant_get(a, '$.question_type', 'string') AS t)) AS given",
    ).filter("user_id IS NOT NULL AND (identify OR raw_event IS NOT NULL)")
    asked = "filter(given, a -> a.q IS NOT NULL AND a.x IS NOT NULL AND NOT is_variant_null(a.x))"
    rated = "filter(transform(filter(given, a -> a.t = 'rating'), a -> try_variant_get(a.x, '$', 'double')), r -> r IS NOT NULL)"
    keys = f"array_distinct(transform({asked}, a -> a.q))"
    plain = f"map_from_arrays({keys}, transform({keys}, k -> flatten(transform(filter({asked}, a -> a.q = k), a -> {_values('a.x')}))))"
    rating = f"map('rating', array(CAST(element_at({rated}, -1) AS STRING)))"
    surveyed = f"IF(size({rated}) > 0, map_concat(map_filter({plain}, (k, a) -> k <> 'rating'), {rating}), {plain})"
    traits = f"transform_values(map_filter(traits, (k, x) -> NOT is_variant_null(x)), (k, x) -> {_values('x')})"
    shown = (
        f"filter(transform(coalesce(candidates, array()), c -> {content_id_sql('coalesce(' + _text('c', '$.content_id') + ', ' + _bare('c', '$') + ')')}), "
        "c -> c IS NOT NULL)"
    )
    reason = _text("v", "$.properties.details.reason")
    none = "CAST(map() AS MAP<STRING, ARRAY<STRING>>)"
    return kinds.selectExpr(
        *others,
        "user_id",
        "IF(identify, 'IDENTIFY', raw_event) AS event",
        "coalesce(try_to_timestamp(time_text), _ingest) AS ts",
        "try_to_timestamp(time_text) IS NULL AS ts_missing",
        f"IF(identify, NULL, coalesce({_text('v', '$.properties.context.session_id')}, {_text('v', '$.sessionId')})) AS session_id",
        f"IF(identify, NULL, coalesce({_text('v', '$.properties.details.request_id')}, {_text('v', '$.properties.context.request_id')}, "
        f"{_text('v', '$.properties.request_id')})) AS request_id",
        f"IF(identify, NULL, {content_id_sql('content')}) AS content_id",
        "IF(identify, NULL, try_variant_get(v, '$.properties.details.dwell_seconds', 'double')) AS dwell_seconds",
        f"IF(identify OR {reason} NOT IN {END_REASONS}, NULL, {reason}) AS end_reason",
        f"IF(identify, NULL, {_text('v', '$.properties.details.query_text')}) AS query_text",
        f"IF(identify, NULL, {content_id_sql(_text('v', '$.properties.details.clicked_id'))}) AS clicked_id",
        f"IF(identify, CAST(array() AS ARRAY<STRING>), {shown}) AS impressions",
        f"coalesce(IF(identify, {traits}, {surveyed}), {none}) AS survey_answers",
        "_raw AS raw",
    )


# Parts of the properties that the fixed columns and the rules below cover.
KNOWN_PARTS = ("content", "details", "context", "answers")


def event_metadata(events: DataFrame) -> DataFrame:
    """(event columns, meta map): what the raw payload says beside the fixed columns.

    Details and context (context wins, without its candidates, which are counted), other properties that are single values,
    the single values of nested ones such as panels, and the survey answers. Empty values, request and session ids are left
    out, and the reason where it is a recognised end reason.
    """
    def fields(path: str) -> str:
        return f"coalesce(try_variant_get(_v, '{path}', 'map<string,variant>'), CAST(map() AS MAP<STRING, VARIANT>))"

    single = "schema_of_variant({0}) RLIKE '^(STRING|BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$'"
    parts = events.withColumn("_v", F.expr("try_parse_json(raw)")).selectExpr(
        "* EXCEPT (_v)", f"{fields('$.properties.details')} AS _details", f"map_filter({fields('$.properties.context')}, (k, x) -> k <> 'candidates') AS _context",
        f"map_filter({fields('$.properties')}, (k, x) -> k NOT IN {KNOWN_PARTS}) AS _others",
        "size(try_variant_get(_v, '$.properties.context.candidates', 'array<variant>')) AS _candidates",
    )
    nested = (f"aggregate(map_entries(map_filter(_others, (k, x) -> schema_of_variant(x) LIKE 'OBJECT%')), CAST(array() AS ARRAY<STRUCT<key: STRING, value: VARIANT>>), "
              f"(s, e) -> concat(s, map_entries(map_filter(coalesce(try_variant_get(e.value, '$', 'map<string,variant>'), CAST(map() AS MAP<STRING, VARIANT>)), (k, x) -> {single.format('x')}))))")
    rows = (f"concat(map_entries(map_filter(_details, (k, x) -> NOT map_contains_key(_context, k))), map_entries(_context), "
            f"map_entries(map_filter(_others, (k, x) -> {single.format('x')})), {nested})")
    text = f"transform({rows}, e -> struct(e.key AS k, try_variant_get(e.value, '$', 'string') AS x))"
    kept = ("filter(_text, e -> e.x IS NOT NULL AND e.x NOT IN ('', '[]') AND e.k NOT IN ('request_id', 'session_id') AND NOT (e.k = 'reason' AND end_reason IS NOT NULL))")
    counted = "IF(_candidates > 0, array(struct('candidates' AS k, CAST(_candidates AS STRING) AS x)), array())"
    answered = "IF(size(survey_answers) > 0, array(struct('answers' AS k, to_json(survey_answers) AS x)), array())"
    whole = parts.selectExpr("* EXCEPT (_details, _context, _others)", f"{text} AS _text").selectExpr("* EXCEPT (_text, _candidates)", f"concat({kept}, {counted}, {answered}) AS _rows")
    # Of values with one name the last counts.
    return whole.selectExpr("* EXCEPT (_rows)", "map_from_entries(filter(transform(_rows, (e, i) -> IF(exists(slice(_rows, i + 2, size(_rows)), l -> l.k = e.k), NULL, e)), e -> e IS NOT NULL)) AS meta")
