"""Vector expressions as Spark SQL text, and small numpy helpers over rows of vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (acc, x) -> acc + x)"


def norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (acc, x) -> acc + x * x))"


def cosine(a: str, b: str) -> str:
    """Cosine in [-1, 1]; 0 when a side is missing, zero or of another length."""
    return f"(CASE WHEN size({a}) = size({b}) THEN coalesce(try_divide({dot(a, b)}, {norm(a)} * {norm(b)}), 0D) ELSE 0D END)"


def unit(a: str) -> str:
    """L2-normalised copy; a zero vector is returned unchanged. The length is taken once, not once for each component."""
    return f"transform(array({norm(a)}), unit_n -> IF(unit_n > 0, transform({a}, unit_x -> unit_x / unit_n), {a}))[0]"


def vector_sums(vec: str, dim: int, weight: str = "1D") -> list[Column]:
    """Aggregates s0, s1, ... that add up vectors of `dim` components, null ones as 0: plain numbers, so hash aggregates hold them."""
    terms = [f"coalesce(IF({weight} <> 0D, {weight} * {vec}[{i}], 0D), 0D)" for i in range(dim)]
    return [F.expr(f"sum({t}) AS s{i}") for i, t in enumerate(terms)] or [F.expr("count(*) AS s0")]


def summed(dim: int) -> str:
    """The vector of the sums that `vector_sums` made."""
    return f"CAST(array({', '.join(f's{i}' for i in range(dim))}) AS ARRAY<DOUBLE>)"


def haversine_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = (
        f"pow(sin(radians({lat2} - {lat1}) / 2D), 2D) + cos(radians({lat1})) * cos(radians({lat2}))"
        f" * pow(sin(radians({lon2} - {lon1}) / 2D), 2D)"
    )
    return f"(2D * {EARTH_RADIUS_M}D * asin(least(1D, sqrt({h}))))"


def unit_rows(m: np.ndarray) -> np.ndarray:
    """The rows at length 1; zeros for a row whose length is 0 or no number."""
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def cosines(rows: np.ndarray, target) -> np.ndarray:
    """Cosine of each unit row with one target vector (0 if it has another length)."""
    if len(target) != rows.shape[1]:
        return np.zeros(len(rows))
    return rows @ unit_rows(np.asarray(target, dtype=np.float64).reshape(1, -1))[0]


def best_match(rows: np.ndarray, liked: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per unit row: max over liked unit rows of weight x (cosine + 1) / 2, at least 0."""
    if not len(weights):
        return np.zeros(len(rows))
    return np.maximum((((rows @ liked.T + 1.0) / 2.0) * weights).max(axis=1), 0.0)


def mmr_order(scores: np.ndarray, rows: np.ndarray, lambda_: float, limit: int) -> np.ndarray:
    """Greedy maximal-marginal-relevance order of one bounded list of unit rows, sorted by (score desc, id), as positions from 0."""
    n = len(scores)
    closest = np.full(n, -np.inf)
    free = np.ones(n, dtype=bool)
    order = []
    while len(order) < min(limit, n):
        value = scores if not order else lambda_ * scores - (1.0 - lambda_) * closest
        best = int(np.argmax(np.where(free, value, -np.inf)))
        order.append(best)
        free[best] = False
        closest = np.maximum(closest, rows @ rows[best])
    return np.asarray(order, dtype=np.int64)
