"""Deterministic text vectors: token counts in hash buckets, L2-normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.vectors import unit


def text_vectors(texts: DataFrame, dim: int, key: str = "id", text: str = "text") -> DataFrame:
    """(key, vec): each lower-case token counts in bucket md5(token) mod dim.

    The 128-bit hash is reduced in four 32-bit steps. Whole texts are tokenised; counts
    are combined map-side, so a long text does not travel as tokens.
    """
    carry = (1 << 32) % dim
    bucket = "0L"
    for part in range(4):
        bucket = f"({bucket} * {carry}L + CAST(conv(substring(h, {part * 8 + 1}, 8), 16, 10) AS BIGINT)) % {dim}L"
    tokens = texts.selectExpr(key, rf"explode_outer(split(trim(regexp_replace(lower({text}), '\\s+', ' ')), ' ')) AS token")
    hashed = tokens.selectExpr(key, "IF(token = '', NULL, md5(token)) AS h").selectExpr(key, f"{bucket} AS bucket")
    counts = ", ".join(f"CAST(count_if(bucket = {i}) AS DOUBLE)" for i in range(dim))
    return hashed.groupBy(key).agg(F.expr(f"array({counts}) AS v")).selectExpr(key, f"{unit('v')} AS vec")
