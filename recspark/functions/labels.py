"""Canonical form of tag labels and keys, computed once per distinct label."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Substring spelling unifications.
SPELLING = [("labour", "labor"), ("theatre", "theater"), ("tranport", "transport")]

# Normalised label -> normalised label.
ALIASES = {
    "from: united kindom": "from: united kingdom",
    "barak": "barrack",
    "transitcamp": "transit camp",
    "commandant's house": "commander's house",
    "commanders house": "commander's house",
    "joods leven": "jewish life",
    "daders & omstanders": "perpetrators & bystanders",
    "verzet": "resistance",
    "volksdeutche": "volksdeutsche",
    "death and mortality": "deaths and mortality",
    "death": "deaths and mortality",
    "social dynamics": "social relations",
    "biography": "biographical text",
    "personal story": "personal stories",
    "photography": "photograph",
    "prisoners": "prisoner",
}

TYPOGRAPHIC = "“”‘’"
PLAIN = "\"\"''"


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"



@F.pandas_udf(T.StringType())
def fold_accents(labels: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, then full case folding."""

    def one(s):
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()

    return labels.map(one)


def _finish(folded: str) -> str:
    out = f"trim({folded})"
    for a, b in SPELLING:
        out = f"replace({out}, '{a}', '{b}')"
    out = rf"trim(regexp_replace({out}, '[\\s_\\-]+', ' '))"
    aliases = "map(" + ", ".join(sql_text(x) for pair in ALIASES.items() for x in pair) + ")"
    return f"coalesce({aliases}[{out}], {out})"


PLAIN_LABEL = f"translate({{label}}, {sql_text(TYPOGRAPHIC)}, {sql_text(PLAIN)})"


def with_norm_label(df: DataFrame, label: str, out: str = "norm_label") -> DataFrame:
    """Add the canonical form of a label column.

    ASCII labels are normalised in place. Spark has no Unicode decomposition, so labels
    with other letters go through Python once per distinct label; where there are none
    that side of the join is empty and adaptive execution drops it.
    """
    columns = [c for c in df.columns if c != out]
    accents = rf"{label} RLIKE '[^\\x00-\\x7F]'"
    folded = (
        df.filter(accents).selectExpr(f"{label} AS _raw").distinct()
        .withColumn("_folded", fold_accents(F.expr(PLAIN_LABEL.format(label="_raw"))))
        .selectExpr("_raw", f"{_finish('_folded')} AS _norm")
    )
    simple = _finish(f"lower({label})")
    return df.join(folded, df[label] == folded["_raw"], "left").selectExpr(
        *columns, f"coalesce(_norm, {simple}) AS {out}"
    )


def decode_machine_tag(tag: str) -> str:
    """``AiARLocationBarrack56`` becomes ``Barrack 56``; other tags pass through."""
    spaced = f"regexp_replace(substring({tag}, 13), '(?<=[a-z])(?=[A-Z])', ' ')"
    spaced = f"trim(regexp_replace({spaced}, '(?<=[A-Za-z])(?=[0-9])', ' '))"
    return f"IF(lower(substring({tag}, 1, 12)) = 'aiarlocation', {spaced}, {tag})"


def with_nkey(df: DataFrame, key: str = "key", out: str = "nkey") -> DataFrame:
    """Add the canonical form of a ``facet:label`` key, split at the first colon."""
    columns = [c for c in df.columns if c != out]
    split = df.selectExpr(
        *columns,
        f"IF(contains({key}, ':'), lower(trim(substring_index({key}, ':', 1))), NULL) AS _facet",
        f"regexp_replace({key}, '^[^:]*:', '') AS _label",
    )
    return with_norm_label(split, "_label").selectExpr(
        *columns, f"IF(_facet IS NULL, norm_label, concat(_facet, ':', norm_label)) AS {out}"
    )
