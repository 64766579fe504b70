"""Imports every query module so that the registry is complete."""

from recspark.plans import bandit_queries, cohort_queries, insight_queries, log_queries, recommend_queries, rebuild_queries, replay_queries, signal_queries, source_queries  # noqa: F401
from recspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
