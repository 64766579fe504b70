"""The largest cosine to a set of likes that changes with every view.

A like is held from the view that earned it to the item's next view: an interval over the places of a visitor's views.
A view asks all intervals that hold it. Places are cut into leaves; over these lies a binary tree, and an interval goes
to the two leaves it ends in and to the O(log n) nodes that cover what lies between, so that each pair of a view and a like
held then meets in one node. There views and likes meet in blocks of bounded size, as products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Views of a leaf, and likes of a block.
LEAF = 256
# Nodes that cover the leaves from `lo` (included) to `hi` (not included): at most two on each level.
_COVER = """
flatten(transform(sequence(0, 40), k -> filter(
  array(named_struct('level', k, 'node', (lo + shiftleft(1L, k) - 1) div shiftleft(1L, k), 'side', 0),
        named_struct('level', k, 'node', hi div shiftleft(1L, k) - 1, 'side', 1)),
  c -> (lo + shiftleft(1L, k) - 1) div shiftleft(1L, k) < hi div shiftleft(1L, k) AND (c.node + c.side) % 2 = 1)))
"""


def _units(flat: object, n: int) -> np.ndarray:
    m = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each view and block of likes: log2 of the best weighted match, and of the largest weight."""
    for pdf in batches:
        for user, ids, places, q, start, end, log_weight, known, likes in zip(*(pdf[c] for c in ("user_id", "ids", "places", "q", "start", "end", "log_weight", "known", "likes")), strict=True):
            at = np.asarray(places)[:, None]
            held = (np.asarray(start) <= at) & (at <= np.asarray(end))
            weights = np.asarray(log_weight, dtype=np.float64)
            top = np.where(held, weights, -np.inf).max(axis=1)
            match = np.full(len(top), -np.inf)
            usable = np.flatnonzero(np.asarray(known, dtype=bool))
            if len(usable):
                alike = (_units(q, len(places)) @ _units(likes, len(weights))[usable].T + 1.0) / 2.0
                with np.errstate(divide="ignore"):
                    match = np.where(held[:, usable], weights[usable] + np.log2(np.maximum(alike, 0.0)), -np.inf).max(axis=1)
            rows = np.flatnonzero(top > -np.inf)
            if len(rows):
                yield pd.DataFrame({"user_id": user, "event_id": np.asarray(ids, dtype=object)[rows], "match": match[rows], "top": top[rows]})


def held_affinity(states: DataFrame, vectors: DataFrame, dim: int, leaf: int = LEAF) -> DataFrame:
    """(user_id, event_id, affinity) of every view of an item with a vector that some like precedes.

    states: user_id, event_id, content_id, place (0, 1, ... in a visitor's order of views), next_place (of the same
    item, null without one) and log_weight: log2 of the weight with which the item is liked after the view, null if it is
    not. The affinity is the largest of weight * (cosine + 1) / 2 over the likes held before the view, divided by the
    largest weight among them; a like without a vector counts for that largest weight only.

    A visitor with up to `leaf` views is one block; the views of others go to one node on each level on which nodes can lie between two leaves. The likes of a
    node are held at one time or meet the same leaf, so there are at most as many as the catalogue has items, plus a leaf.
    """
    kind = states.schema["event_id"].dataType.simpleString()
    user_kind = states.schema["user_id"].dataType.simpleString()
    zero = f"array_repeat(0D, {dim})"
    last = states.groupBy("user_id").agg(F.expr("max(place) AS last"))
    have = vectors.filter("vec IS NOT NULL").select("content_id", "vec")
    asked = states.join(have, "content_id").selectExpr("user_id", f"place div {leaf} AS leaf", "struct(place, event_id, vec) AS v")
    packs = asked.groupBy("user_id", "leaf").agg(F.expr("array_sort(collect_list(v), (a, b) -> CAST(sign(a.place - b.place) AS INT)) AS v")).join(last, "user_id")
    packs = packs.selectExpr("user_id", "leaf", "v.event_id AS ids", "v.place AS places", "flatten(v.vec) AS q",
                             f"explode(sequence(0, length(bin(greatest(last div {leaf} - 1, 1))) - 1)) AS level").withColumn("node", F.expr("shiftright(leaf, level)"))
    liked = states.filter("log_weight IS NOT NULL").join(last, "user_id").selectExpr(
        "user_id", "content_id", "log_weight", "place + 1 AS start", "coalesce(next_place, last) AS end").filter("start <= end")
    spans = liked.join(have, "content_id", "left").selectExpr(
        "*", f"start div {leaf} AS first", f"end div {leaf} AS final", f"start div {leaf} + 1 AS lo", f"end div {leaf} AS hi")
    ends = "array_distinct(array(named_struct('level', 0, 'node', first), named_struct('level', 0, 'node', final)))"
    inner = f"transform({_COVER}, c -> named_struct('level', c.level, 'node', c.node))"
    spread = spans.selectExpr("user_id", "content_id", "start", "end", "log_weight", "vec", f"inline(concat({ends}, IF(lo < hi, {inner}, array())))")
    blocks = spread.withColumn("block", F.expr(f"(row_number() OVER (PARTITION BY user_id, level, node ORDER BY start, content_id) - 1) div {leaf}"))
    likes = blocks.groupBy("user_id", "level", "node", "block").agg(
        F.expr(f"collect_list(struct(start, end, log_weight, vec IS NOT NULL AS known, coalesce(vec, {zero}) AS vec)) AS l")).selectExpr(
        "user_id", "level", "node", "l.start AS start", "l.end AS end", "l.log_weight AS log_weight", "l.known AS known", "flatten(l.vec) AS likes")
    met = packs.join(likes, ["user_id", "level", "node"]).select("user_id", "ids", "places", "q", "start", "end", "log_weight", "known", "likes")
    best = met.mapInPandas(_best, f"user_id {user_kind}, event_id {kind}, match double, top double")
    return best.groupBy("user_id", "event_id").agg(F.expr("pow(2D, max(match) - max(top)) AS affinity"))
