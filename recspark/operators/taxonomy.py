"""Tag taxonomy: term index from a taxonomy file, and facet assignment of raw tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark.functions.labels import decode_machine_tag, with_norm_label

# ---------------------------------------------------------------------------------------
# Fixed values: (dimension, group) -> facet, prefixes, patterns, rollups, default.
# ---------------------------------------------------------------------------------------
GROUP_FACET = {
    ("person_who", "Reason for imprisonment"): "person_who.reason_for_imprisonment",
    ("person_who", "Age group"): "person_who.age_group",
    ("person_who", "Gender and age"): "person_who.gender_and_age",
    ("person_who", "Mothertongue"): "person_who.mothertongue",
    ("person_who", "Province (Netherlands)"): "person_who.province_netherlands",
    ("person_who", "City/village & country"): "person_who.city_village_country",
    ("place_where", "Camp areas"): "place_where.camp_areas",
    ("place_where", "Barrack number"): "place_where.camp_areas",
    ("place_where", "Transit destinations (arrived from, deported to)"): "place_where.transit_destinations",
    ("time_when", "Time period"): "time_when.time_period",
    ("theme_how", "AI Engine themes Westerbork"): "theme_how.ai_engine_themes",
    ("theme_how", "Type of stores"): "theme_how.type_of_stores",
    ("theme_how", "Daily Life & Camp Experience"): "theme_how.type_of_stores",
    ("theme_how", "Historical Context & Overview"): "theme_how.type_of_stores",
    ("theme_how", "Reflections & Encounters"): "theme_how.type_of_stores",
}
PREFIX_FACET = {
    "from:": "person_who.city_village_country", "born in:": "person_who.city_village_country",
    "lived in:": "person_who.city_village_country", "live in:": "person_who.city_village_country",
    "deported to:": "place_where.transit_destinations", "arrived from:": "place_where.transit_destinations",
    "transported to:": "place_where.transit_destinations", "transferred to:": "place_where.transit_destinations",
    "died in:": "place_where.transit_destinations", "interned in:": "place_where.transit_destinations",
    "imprisoned in:": "place_where.transit_destinations", "in:": "place_where.transit_destinations",
}
PATTERN_FACET = [
    (r"^age [0-9]{2}( [0-9]{2}|\\+| \\+)?$", "person_who.age_group"),
    (r"^[0-9]{2}( [0-9]{2})?(\\+| \\+)?( years)?$", "person_who.age_group"),
    (r"\\(tone\\)$", "language_how.tone"),
    (r"^barrack(s)? [0-9]", "place_where.camp_areas"),
    (r"^camp ", "place_where.transit_destinations"),
]
ROLLUP_FACET = {"international": "person_who.city_village_country"}
DEFAULT_FACET = "theme_what"
# ---------------------------------------------------------------------------------------

FILE_SCHEMA = (
    "dimensions array<struct<key string, main_tags array<struct<tag string, subtags array<string>>>, "
    "groups array<struct<label string, subtags array<string>>>, subtags array<string>>>"
)


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A taxonomy JSON file as rows (seq, kind, dimension, parent, term)."""
    dims = spark.read.schema(FILE_SCHEMA).option("multiLine", True).json(path).selectExpr("posexplode(dimensions) AS (d, dim)")
    mains = dims.selectExpr("d", "dim.key AS dimension", "posexplode(dim.main_tags) AS (i, m)")
    groups = dims.selectExpr("d", "dim.key AS dimension", "posexplode(dim.groups) AS (i, g)")
    parts = [
        mains.selectExpr("d", "i", "0 AS j", "'main' AS kind", "dimension", "m.tag AS parent", "m.tag AS term"),
        mains.selectExpr("d", "i", "dimension", "m.tag AS parent", "posexplode(m.subtags) AS (j, term)").selectExpr(
            "d", "i", "j + 1 AS j", "'sub' AS kind", "dimension", "parent", "term"),
        groups.selectExpr("d", "i", "dimension", "g.label AS parent", "posexplode(g.subtags) AS (j, term)").selectExpr(
            "d", "i", "j", "'group' AS kind", "dimension", "parent", "term"),
        groups.filter("dimension = 'theme_how' AND coalesce(size(g.subtags), 0) <= 0").selectExpr(
            "d", "i", "0 AS j", "'group' AS kind", "dimension", "g.label AS parent", "g.label AS term"),
        dims.selectExpr("d", "dim.key AS dimension", "posexplode(dim.subtags) AS (i, term)").selectExpr(
            "d", "i", "0 AS j", "'plain' AS kind", "dimension", "CAST(NULL AS STRING) AS parent", "term"),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.selectExpr("struct(d, i, j) AS seq", "kind", "dimension", "parent", "term").filter("term IS NOT NULL")


def tag_index(terms: DataFrame) -> DataFrame:
    """(norm_label, facet, main): the first facet of each term, and the main tag of subtags.

    ``a/b c`` also counts as ``a c``, ``b c``, ``a`` and ``b c``.
    """
    head, tail = "substring_index(term, ' ', 1)", "IF(contains(term, ' '), substring(term, instr(term, ' ') + 1), '')"
    with_head = f"IF(contains({head}, '/'), transform(split({head}, '/'), o -> trim(concat(o, ' ', {tail}))), CAST(array() AS ARRAY<STRING>))"
    variants = f"IF(contains(term, '/'), concat({with_head}, transform(split(term, '/'), o -> trim(o)), array(term)), array(term))"
    groups = "map(" + ", ".join(f"'{d}|{g}', '{f}'" for (d, g), f in GROUP_FACET.items()) + ")"
    facet = f"CASE kind WHEN 'main' THEN 'theme_what' WHEN 'sub' THEN 'theme_what' WHEN 'group' THEN {groups}[concat(dimension, '|', parent)] ELSE dimension END"
    rows = terms.selectExpr("seq", "kind", "parent", f"{facet} AS facet", f"explode({variants}) AS variant").filter("facet IS NOT NULL")
    named = with_norm_label(with_norm_label(rows, "variant", "norm_label"), "parent", "norm_main")
    return named.groupBy("norm_label").agg(
        F.expr("min_by(facet, seq) AS facet"), F.expr("max_by(norm_main, IF(kind = 'sub', seq, NULL)) AS main")
    )


def assign_facets(tags: DataFrame, index: DataFrame, column: str = "tag") -> DataFrame:
    """Adds facet, label, source and rollup to raw tags: subtag, rollup, exact, pattern, prefix, default."""
    decoded = with_norm_label(tags.selectExpr("*", f"{decode_machine_tag(column)} AS _decoded"), "_decoded", "label").drop("_decoded")
    joined = decoded.join(index.withColumnRenamed("norm_label", "label").withColumnRenamed("facet", "known"), "label", "left")
    rollup = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in ROLLUP_FACET.items()) + ")[label]"
    pattern = "CASE " + " ".join(f"WHEN label RLIKE '{p}' THEN '{f}'" for p, f in PATTERN_FACET) + " END"
    longest = sorted(PREFIX_FACET.items(), key=lambda p: -len(p[0]))
    prefix = "CASE " + " ".join(f"WHEN startswith(label, '{p}') THEN '{f}'" for p, f in longest) + " END"
    return joined.selectExpr(
        *tags.columns, "label",
        f"CASE WHEN main IS NOT NULL THEN 'theme_what' ELSE coalesce({rollup}, known, {pattern}, {prefix}, '{DEFAULT_FACET}') END AS facet",
        f"CASE WHEN main IS NOT NULL THEN 'subtag' WHEN {rollup} IS NOT NULL THEN 'rollup' WHEN known IS NOT NULL THEN 'exact' "
        f"WHEN {pattern} IS NOT NULL THEN 'pattern' WHEN {prefix} IS NOT NULL THEN 'prefix' ELSE 'default' END AS source",
        "IF(main <> label, main, NULL) AS rollup",
    )


def expand_tags(assigned: DataFrame, weight: float = 1.0, rollup_weight: float | None = None) -> DataFrame:
    """Granular tag rows plus the parent main tag of theme subtags."""
    kept = [c for c in assigned.columns if c not in ("facet", "label", "source", "rollup")]
    up = weight if rollup_weight is None else rollup_weight
    return assigned.selectExpr(
        *kept,
        f"inline(array_compact(array(named_struct('facet', facet, 'label', label, 'weight', {weight}D), "
        f"IF(rollup IS NULL, NULL, named_struct('facet', 'theme_what', 'label', rollup, 'weight', {up}D)))))",
    )


def audit(assigned: DataFrame) -> DataFrame:
    """Vocabulary counts by the rule that classified the tag."""
    return assigned.groupBy("source", "facet").agg(F.expr("count(*) AS tags"))
