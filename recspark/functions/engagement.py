"""Engagement scoring as Spark SQL expression text.

Builders take and return SQL text: use them in ``selectExpr`` or ``F.expr``. Everything
is built-in and stays inside whole-stage codegen.
"""

from __future__ import annotations

from datetime import datetime

from recspark.config import RecConfig

# How the way a view ended maps to a completion signal.
COMPLETION = {"next_button": 1.0, "link": 0.6, "close_button": 0.0, "abandon": -0.5}


def timestamp_sql(value: datetime | str) -> str:
    return value if isinstance(value, str) else f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}+00:00'"


def reading_time(words: str, has_image: str, cfg: RecConfig) -> str:
    base = f"({words}) / {cfg.reading_speed_wps}D" if cfg.reading_speed_wps > 0 else "0D"
    return f"({base} + IF({has_image}, {cfg.img_extra_time}D, 0D))"


def dwell_ratio(dwell: str, estimate: str, cfg: RecConfig) -> str:
    cap = f"{cfg.dwell_cap_ratio}D"
    return (
        f"(CASE WHEN {dwell} IS NULL OR {dwell} <= 0 THEN 0D WHEN {estimate} <= 0 THEN 1D "
        f"ELSE least({dwell} / {estimate}, {cap}) / {cap} END)"
    )


def completion(reason: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {value}D" for name, value in COMPLETION.items())
    return f"(CASE {reason} {cases} ELSE 0D END)"


def strength(dwell: str, estimate: str, reason: str, visits: str, rating: str, cfg: RecConfig) -> str:
    w = cfg.engagement
    revisit = f"(1D - exp(-greatest({visits}, 0) / 2D))"
    survey = f"coalesce(({rating} - 3D) / 2D, 0D)"
    return (
        f"({w.dwell}D * {dwell_ratio(dwell, estimate, cfg)} + {w.completion}D * {completion(reason)}"
        f" + {w.revisit}D * {revisit} + {w.survey}D * {survey})"
    )


def outcome(value: str, cfg: RecConfig) -> str:
    return (
        f"(CASE WHEN {value} >= {cfg.positive_threshold}D THEN 'positive' "
        f"WHEN {value} <= {cfg.negative_threshold}D THEN 'negative' ELSE 'neutral' END)"
    )


def decay(ts: str, now: datetime | str, cfg: RecConfig) -> str:
    """Half-life decay; ages below zero count as zero, a missing time as fresh."""
    if cfg.half_life_days <= 0:
        return "1D"
    age_days = f"greatest(unix_micros({timestamp_sql(now)}) - unix_micros({ts}), 0) / 86400e6D"
    return f"coalesce(pow(0.5D, {age_days} / {cfg.half_life_days}D), 1D)"


def age_bucket(age: str) -> str:
    return (
        f"(CASE WHEN {age} < 18 THEN 'child' WHEN {age} <= 24 THEN 'age 18-24' WHEN {age} <= 34 THEN 'age 25-34' "
        f"WHEN {age} <= 44 THEN 'age 35-44' WHEN {age} <= 54 THEN 'age 45-54' WHEN {age} <= 64 THEN 'age 55-64' "
        f"WHEN {age} IS NOT NULL THEN 'elderly' END)"
    )
