"""Catalogue payloads and curation, and the JSON-lines loaders of the offline bandit jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTENT_TYPES = ("text_item", "image_item", "video_item", "audio_item", "exhibition", "tag", "poi")  # fixed values
TAG_TYPE = "array<struct<facet string, label string, weight double>>"
CONTENT_LINE = (
    "id string, title string, text string, word_count int, has_image boolean, lat double, lon double, "
    f"tags {TAG_TYPE}, vector array<double>"
)
SESSION_LINE = (
    "user_id string, views array<struct<content_id string, dwell_seconds double, end_reason string, visits int, ts string>>"
)
SAMPLE_LINE = "features array<double>, reward double"


def read_content_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENT_LINE).json(path)


def write_content_lines(contents: DataFrame, tags: DataFrame, vectors: DataFrame, path: str) -> None:
    """The catalogue as JSON lines, tags in their order and the vector inside."""
    packed = tags.groupBy("content_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, facet, label, weight))), t -> struct(t.facet, t.label, t.weight)) AS tags"))
    rows = contents.join(packed, "content_id", "left").join(vectors.select("content_id", "vec"), "content_id", "left")
    rows.selectExpr("content_id AS id", "title", "text", "word_count", "has_image", "lat", "lon", "tags", "vec AS vector").write.json(path)


# Views of one line, about.
LINE_VIEWS = 1000


def write_session_views(views: DataFrame, path: str, line_views: int = LINE_VIEWS) -> None:
    """Views (user_id, content_id, dwell_seconds, end_reason, ts) as JSON lines of a visitor's day.

    A day with more than `line_views` views is dealt to several lines by a hash, so that no line grows with a busy visitor.
    """
    view = "struct(content_id, dwell_seconds, end_reason, CAST(NULL AS INT) AS visits, date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS ts)"
    rows = views.withColumn("day", F.to_date("ts"))
    lines = rows.groupBy("user_id", "day").agg(F.expr(f"ceil(count(*) / {line_views}) AS lines"))
    dealt = rows.join(lines, ["user_id", "day"]).withColumn("line", F.expr("pmod(xxhash64(ts, content_id, dwell_seconds), lines)"))
    dealt.groupBy("user_id", "day", "line").agg(F.expr(f"collect_list({view}) AS views")).select("user_id", "views").write.json(path)


def read_session_views(spark: SparkSession, path: str) -> DataFrame:
    """One row per view: user_id, content_id, dwell_seconds, end_reason, visits, ts."""
    views = spark.read.schema(SESSION_LINE).json(path).selectExpr("user_id", "explode(views) AS x")
    return views.selectExpr(
        "user_id", "x.content_id", "x.dwell_seconds", "x.end_reason", "coalesce(x.visits, 1) AS visits", "try_to_timestamp(x.ts) AS ts"
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE_LINE).json(path)


def normalize_catalogue(payloads: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """Typed contents of raw JSON payloads: type, tags, word count, image, place and years."""
    v = payloads.selectExpr(f"CAST({key} AS STRING) AS content_id", f"try_parse_json({payload}) AS v")

    def text(*paths: str) -> str:
        found = ", ".join(f"nullif(try_variant_get(v, '{p}', 'string'), '')" for p in paths)
        return f"coalesce({found})" if len(paths) > 1 else found

    def place(axis: str) -> str:
        spots = ["$.locations[0]", "$.locations", "$.location[0]", "$.location"]
        pairs = " ".join(
            f"WHEN try_variant_get(v, '{s}.lat', 'double') IS NOT NULL AND try_variant_get(v, '{s}.lon', 'double') IS NOT NULL "
            f"THEN try_variant_get(v, '{s}.{axis}', 'double')" for s in [*spots, "$"]
        )
        return f"CASE {pairs} END"

    image = text("$.image_url", "$.imageUrl", "$.thumbnail_url")
    dates = (
        "coalesce(try_variant_get(v, '$.time_metadata.dates_of_creation', 'array<string>'), "
        "array(try_variant_get(v, '$.time_metadata.dates_of_creation', 'string')))"
    )
    fallback = "coalesce(try_variant_get(v, '$.time_metadata.date', 'array<string>'), array(try_variant_get(v, '$.time_metadata.date', 'string')))"
    tokens = f"concat_ws(' ', IF(size(filter({dates}, x -> x <> '')) > 0, {dates}, {fallback}))"
    words = "coalesce(nullif(try_variant_get(v, '$.text_length_words', 'int'), 0), try_variant_get(v, '$.word_count', 'int'), 0)"
    kind = "try_variant_get(v, '$.content_type', 'string')"
    tags = (
        "transform(coalesce(try_variant_get(v, '$.tags', 'array<variant>'), array()), t -> named_struct("
        "'facet', coalesce(try_variant_get(t, '$.facet', 'string'), 'unknown'), 'label', coalesce(try_variant_get(t, '$.label', 'string'), ''), "
        "'weight', coalesce(try_variant_get(t, '$.weight', 'double'), 1D)))"
    )
    return v.selectExpr(
        "content_id",
        f"IF({kind} IN {CONTENT_TYPES}, {kind}, 'text_item') AS content_type",
        f"coalesce({text('$.title')}, '') AS title", f"coalesce({text('$.text')}, '') AS text", f"{tags} AS tags", f"{words} AS word_count",
        f"{image} IS NOT NULL OR coalesce(size(try_variant_get(v, '$.files_url', 'array<string>')), 0) > 0 AS has_image",
        f"{place('lat')} AS lat", f"{place('lon')} AS lon", f"{image} AS image_url", f"{text('$.public_url', '$.publicUrl')} AS public_url",
        rf"array_sort(array_distinct(transform(regexp_extract_all({tokens}, '\\b(1[89][0-9][0-9]|20[0-9][0-9])\\b', 1), y -> CAST(y AS INT)))) AS years",
    )


def exploded_tags(contents: DataFrame) -> DataFrame:
    """Long tag table: content_id, pos, facet, label, weight, key."""
    return contents.selectExpr("content_id", "posexplode(tags) AS (pos, t)").selectExpr(
        "content_id", "pos", "t.facet", "t.label", "t.weight", "concat(t.facet, ':', t.label) AS key"
    )


def item_text_columns(items: DataFrame) -> DataFrame:
    """Adds text_all (title, newline, text), char_count, word_count (whitespace split) and, with a files_url, its first as image_url."""
    both = items.selectExpr("*", r"IF(text IS NULL, title, concat(title, '\n', text)) AS text_all")
    if "files_url" in items.columns:
        several = items.schema["files_url"].dataType.typeName() == "array"
        both = both.withColumn("image_url", F.expr("get(files_url, 0)" if several else "files_url"))
    return both.selectExpr(
        "*", "CAST(length(text_all) AS INT) AS char_count",
        r"size(filter(split(text_all, '(?U)\\s+'), w -> w <> '')) AS word_count",
    )


def curate(items: DataFrame, dropped_ids: DataFrame) -> DataFrame:
    """Items for embedding: listed ids and items under five words out, placeholder creator blank."""
    counted = item_text_columns(items).filter("word_count >= 5")
    kept = counted.join(dropped_ids.select("id"), "id", "left_anti")
    return kept.withColumn("creator", F.expr("IF(creator = 'unbekannt', '', creator)"))
