"""All tunables in one frozen dataclass, handed to every job function.

Per-tenant overrides are ``dataclasses.replace(cfg, ...)`` or ``patched(cfg, {...})``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace

# Order of the ranking features everywhere (logs, bandit, fusion).
FEATURES = ("semantic", "affinity", "tag", "recency", "aversion", "geo")


@dataclass(frozen=True)
class EngagementWeights:
    dwell: float = 0.4
    completion: float = 0.3
    revisit: float = 0.2
    survey: float = 0.1


@dataclass(frozen=True)
class FusionWeights:
    tag: float = 0.45
    semantic: float = 0.20
    affinity: float = 0.10
    recency: float = 0.05
    aversion: float = -0.30
    geo: float = 0.20

    def of(self, feature: str) -> float:
        return float(getattr(self, feature, 0.0))


@dataclass(frozen=True)
class RecConfig:
    engagement: EngagementWeights = field(default_factory=EngagementWeights)
    fusion: FusionWeights = field(default_factory=FusionWeights)
    reading_speed_wps: float = 4.2
    img_extra_time: float = 1.3
    dwell_cap_ratio: float = 2.0
    positive_threshold: float = 0.30
    negative_threshold: float = -0.05
    half_life_days: float = 14.0
    soft_negative_weight: float = 0.30
    pool_per_generator: int = 30
    tag_keys_per_user: int = 20
    pool_before_seen: bool = True  # cut each open pool before (or after) seen items are removed
    final_limit: int = 10
    mmr_lambda: float = 0.7
    geo_scale_m: float = 300.0
    geo_radius_m: float = 1000.0
    filter_reshow_when_exhausted: bool = True
    distractor_enabled: bool = True
    distractor_strategy: str = "max_dissimilar"  # max_dissimilar | unexplored_theme | random
    distractor_probability: float = 1.0
    distractor_slots: tuple[int, ...] = (3, 4)
    cold_start_min_positives: int = 1
    ranking_mode: str = "static"  # static | bandit
    bandit_alpha: float = 0.3
    bandit_ridge: float = 1.0
    bandit_explore: bool = True
    bandit_online: bool = False
    soft_negatives_block: bool = True
    seed: int = 0


def patched(cfg, patch: dict):
    """Recursive merge of a (possibly nested) dict of overrides into a config."""
    known = {f.name for f in fields(cfg)}
    unknown = set(patch) - known
    if unknown:
        raise ValueError(f"unknown config fields: {sorted(unknown)}")
    changes = {}
    for name, value in patch.items():
        current = getattr(cfg, name)
        if is_dataclass(current) and isinstance(value, dict):
            value = patched(current, value)
        elif isinstance(current, tuple) and isinstance(value, list):
            value = tuple(value)
        changes[name] = value
    return replace(cfg, **changes)
