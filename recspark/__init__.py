"""Visitor-engagement analytics and recommendation as set-based PySpark jobs."""

from recspark.config import EngagementWeights, FusionWeights, RecConfig

__all__ = ["EngagementWeights", "FusionWeights", "RecConfig"]
