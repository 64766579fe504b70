"""Six candidate scores, weighted fusion, learned-policy override and diversity rerank."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.config import FEATURES, RecConfig
from recspark.functions.labels import with_nkey
from recspark.operators.candidates import filter_values
from recspark.functions.vectors import best_match, cosines, haversine_m, mmr_order
from recspark.operators.item_lists import Vectors, bounds, dealt, flat_values, list_sizes, typed
from recspark.operators.signals import vector_dim
from recspark.session import materialize

LIKED_CHUNK = 256


@dataclass(frozen=True)
class Catalogue:
    contents: DataFrame
    tags: DataFrame
    vectors: DataFrame

    @cached_property
    def keyed_tags(self) -> DataFrame:
        """The tag table with canonical keys, stored once: most jobs read it several times."""
        return materialize(with_nkey(self.tags))

    @cached_property
    def tags_nkey(self) -> DataFrame:
        """(content_id, nkey, weight): of tags with the same canonical key the last one counts."""
        return self.keyed_tags.groupBy("content_id", "nkey").agg(F.expr("max_by(weight, pos) AS weight"))

    @cached_property
    def values(self) -> DataFrame:
        """(content_id, value): canonical tag values that a location filter is compared with."""
        return filter_values(self.tags)

    @cached_property
    def dim(self) -> int:
        return vector_dim(self.vectors)

    @cached_property
    def n_vectors(self) -> int:
        return self.vectors.count()

    @cached_property
    def vectors_by_id(self) -> DataFrame:
        """(content_id, flat, known): the vectors of an id one after another, zeros for one that is null."""
        one = f"struct(coalesce(vec, array_repeat(0D, {self.dim})) AS vec, vec IS NOT NULL AS known)"
        rows = self.vectors.filter("content_id IS NOT NULL").groupBy("content_id").agg(F.expr(f"array_sort(collect_list({one})) AS c"))
        return rows.selectExpr("content_id", "flatten(c.vec) AS flat", "c.known AS known")


def _score_block(lists: pa.Table, items: pa.Table) -> pa.Table:
    """Semantic, recency and affinity of the lists of one block."""
    vectors = Vectors(items)
    ends, place, row = vectors.of(lists["ids"])
    liked_ends, liked_place, liked_row = vectors.of(lists["liked"])
    weights = flat_values(lists["weights"])
    semantic, recency, affinity = np.zeros((3, len(row)))
    profile = {}
    for name in ("taste", "recency"):
        column = lists[name].combine_chunks()
        profile[name] = column.is_valid().to_numpy(zero_copy_only=False), bounds(list_sizes(column)), flat_values(column)
    for i in range(len(lists)):
        one = slice(ends[i], ends[i + 1])
        rows, known = vectors.rows[row[one]], vectors.known[row[one]]
        for name, out in (("taste", semantic), ("recency", recency)):
            there, cut, flat = profile[name]
            if there[i]:
                out[one] = np.where(known, (cosines(rows, flat[cut[i]:cut[i + 1]]) + 1.0) / 2.0, 0.0)
        mine = slice(liked_ends[i], liked_ends[i + 1])
        held = vectors.known[liked_row[mine]]
        liked = liked_row[mine][held]
        affinity[one] = np.where(known, best_match(rows, vectors.rows[liked], weights[liked_place[mine][held]]), 0.0)
    if len(row):  # of an id with several vectors the best counts
        first = np.flatnonzero(np.diff(place, prepend=-1))
        affinity = np.maximum.reduceat(affinity, first)[place]
    of = pa.array(np.repeat(np.arange(len(lists)), np.diff(ends)))
    return pa.Table.from_arrays([
        lists["request_id"].combine_chunks().take(of), lists["user_id"].combine_chunks().take(of),
        pc.list_flatten(lists["ids"]).combine_chunks().take(pa.array(place)), pa.array(semantic), pa.array(affinity), pa.array(recency),
    ], names=["request_id", "user_id", "content_id", "semantic", "affinity", "recency"])


def vector_scores(candidates: DataFrame, catalogue: Catalogue, taste: DataFrame, recency: DataFrame,
                  positives: DataFrame) -> DataFrame:
    """Adds semantic, affinity and recency to (request_id, user_id, content_id).

    A request's candidates are bounded, so they travel as one list of ids, and vectors go to blocks of lists (`item_lists`);
    a visitor's liked items are cut into chunks whose best matches are merged afterwards.
    """
    key = ["request_id", "user_id"]
    packed = candidates.groupBy(*key).agg(F.expr("array_sort(collect_list(struct(content_id))).content_id AS ids"))
    # The largest like counts whether or not its item has a vector.
    likes = positives.filter("weight > 0")
    scale = likes.groupBy("user_id").agg(F.expr("max(weight) AS top"), F.expr(f"ceil(count(*) / {LIKED_CHUNK}) AS chunks"))
    liked = (
        likes.join(scale, "user_id")
        .selectExpr("user_id", "pmod(xxhash64(content_id), chunks) AS chunk", "struct(content_id, weight / top AS w) AS l")
        .groupBy("user_id", "chunk")
        .agg(F.expr("collect_list(l) AS l"))
        .selectExpr("user_id", "chunk", "l.content_id AS liked", "l.w AS weights")
    )
    first = materialize(packed.join(liked.filter("chunk = 0").drop("chunk"), "user_id", "left"))
    lists, items = dealt(first, key, ["ids", "liked"], catalogue)
    profile = lists.join(taste.select("user_id", "taste"), "user_id", "left").join(recency.select("user_id", "recency"), "user_id", "left")
    schema = typed(candidates, [*key, "content_id"], "semantic double, affinity double, recency double")
    rows = profile.groupBy("block").cogroup(items.groupBy("block")).applyInArrow(_score_block, schema)
    if scale.filter("chunks > 1").isEmpty():
        return rows
    rest = materialize(packed.join(liked.filter("chunk > 0"), "user_id"))
    lists, items = dealt(rest, [*key, "chunk"], ["ids", "liked"], catalogue)
    nothing = lists.selectExpr("*", "CAST(NULL AS ARRAY<DOUBLE>) AS taste", "CAST(NULL AS ARRAY<DOUBLE>) AS recency")
    more = nothing.groupBy("block").cogroup(items.groupBy("block")).applyInArrow(_score_block, schema)
    best = more.groupBy("request_id", "content_id").agg(F.expr("max(affinity) AS other"))
    return rows.join(best, ["request_id", "content_id"], "left").selectExpr(
        "request_id", "user_id", "content_id", "semantic", "greatest(affinity, coalesce(other, 0D)) AS affinity", "recency"
    )


def tag_score(candidates: DataFrame, tags_nkey: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """(request_id, content_id, name): share of the visitor's key weight the item's tags carry."""
    total = weights.groupBy("user_id").agg(F.expr("sum(weight) AS total"))
    per_key = weights.groupBy("user_id", "nkey").agg(F.expr("sum(weight) AS held"))
    matched = (
        candidates.select("request_id", "user_id", "content_id")
        .join(tags_nkey, "content_id")
        .join(per_key, ["user_id", "nkey"])
        .groupBy("request_id", "user_id", "content_id")
        .agg(F.expr("sum(held * weight) AS matched"))
    )
    return matched.join(total, "user_id").selectExpr(
        "request_id", "content_id", f"IF(total > 0, greatest(0D, least(matched / total, 1D)), 0D) AS {name}"
    )


def score_candidates(candidates: DataFrame, catalogue: Catalogue, model, cfg: RecConfig,
                     places: DataFrame | None = None) -> DataFrame:
    """All scores of (request_id, user_id, content_id) rows.

    ``places`` (request_id, lat, lon) gives requests a location; the geo score of other
    requests is null, and such requests carry no geo entry in their breakdown.
    """
    key = ["request_id", "content_id"]
    out = vector_scores(candidates, catalogue, model.taste, model.recency, model.positives)
    out = out.join(tag_score(candidates, catalogue.tags_nkey, model.tag_affinity, "tag"), key, "left")
    out = out.join(tag_score(candidates, catalogue.tags_nkey, model.tag_aversion, "aversion"), key, "left")
    scores = ["semantic", "affinity", "coalesce(tag, 0D) AS tag", "recency", "coalesce(aversion, 0D) AS aversion"]
    if places is None:
        return out.selectExpr("request_id", "user_id", "content_id", *scores, "CAST(NULL AS DOUBLE) AS geo")
    spots = catalogue.contents.selectExpr("content_id", "lat AS item_lat", "lon AS item_lon")
    located = out.join(places.select("request_id", "lat", "lon"), "request_id", "left").join(spots, "content_id", "left")
    distance = haversine_m("lat", "lon", "item_lat", "item_lon")
    geo = f"IF(lat IS NULL OR lon IS NULL, NULL, coalesce(exp(-{distance} / {cfg.geo_scale_m}D), 0D))"
    if cfg.geo_scale_m <= 0:
        geo = "IF(lat IS NULL OR lon IS NULL, NULL, 0D)"
    return located.selectExpr("request_id", "user_id", "content_id", *scores, f"{geo} AS geo")


def fuse(scored: DataFrame, cfg: RecConfig, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Weighted sum, its breakdown map and the ordered feature vector (missing scores 0)."""
    terms = [f"coalesce({cfg.fusion.of(f)}D * {f}, 0D)" for f in features]
    return explained(scored.selectExpr("*", f"{' + '.join(terms)} AS final_score"), cfg, features)


def explained(scored: DataFrame, cfg: RecConfig, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Adds the breakdown map and the feature vector to rows with their scores. They follow from the scores, so they need not be stored."""
    entries = ", ".join(f"'{f}', {cfg.fusion.of(f)}D * {f}" for f in features)
    return scored.selectExpr(
        "*",
        f"map_filter(map({entries}), (k, v) -> v IS NOT NULL) AS breakdown",
        f"array({', '.join(f'coalesce({f}, 0D)' for f in features)}) AS features",
    )


def apply_policy(fused: DataFrame, policy: DataFrame, cfg: RecConfig) -> DataFrame:
    """Score by a trained linear policy (one row: theta, a_inv): theta.x + alpha sqrt(x' A^-1 x)."""
    theta, inverse = policy.select("theta").scalar(), policy.select("a_inv").scalar()
    d = len(FEATURES)
    mean = " + ".join(f"theta[{i}] * features[{i}]" for i in range(d))
    variance = " + ".join(f"a_inv[{i * d + j}] * features[{i}] * features[{j}]" for i in range(d) for j in range(d))
    bonus = f" + {cfg.bandit_alpha}D * sqrt(greatest({variance}, 0D))" if cfg.bandit_explore and cfg.bandit_alpha > 0 else ""
    return (
        fused.withColumn("theta", theta).withColumn("a_inv", inverse)
        .withColumn("final_score", F.expr(f"coalesce({mean}{bonus}, final_score)"))
        .drop("theta", "a_inv")
    )


def _mmr_block(lambda_: float, limit: int):
    def run(lists: pa.Table, items: pa.Table) -> pa.Table:
        vectors = Vectors(items)
        ends, place, row = vectors.of(lists["ids"])
        ids, scores = pc.list_flatten(lists["ids"]).combine_chunks(), flat_values(lists["scores"])
        # Candidates of one list with the same score and id are taken by their vectors.
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (scores[1:] != scores[:-1]) | pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
        first[bounds(list_sizes(lists["ids"]))[:-1]] = True
        by = np.lexsort((row, np.cumsum(first)[place]))
        place, row = place[by], row[by]
        picks = [ends[i] + mmr_order(scores[place[a:b]], vectors.rows[row[a:b]], lambda_, limit) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        sizes = [len(p) for p in picks]
        picked = np.concatenate([*picks, np.zeros(0, dtype=np.int64)])
        rank = np.arange(len(picked)) - np.repeat(bounds(sizes)[:-1], sizes) + 1
        return pa.Table.from_arrays([
            lists["request_id"].combine_chunks().take(pa.array(np.repeat(np.arange(len(lists)), sizes))),
            ids.take(pa.array(place[picked])), pa.array(rank.astype(np.int32)),
        ], names=["request_id", "content_id", "rank"])

    return run


def mmr(scored: DataFrame, catalogue: Catalogue, cfg: RecConfig) -> DataFrame:
    """(request_id, content_id, rank): greedy relevance/diversity order, cfg.final_limit long.

    The candidates of one request are bounded by the pool size, so a request is one list of ids.
    """
    packed = materialize(
        scored.groupBy("request_id").agg(F.expr("array_sort(collect_list(struct(-final_score AS s, content_id))) AS c"))
        .selectExpr("request_id", "c.content_id AS ids", "transform(c.s, s -> -s) AS scores")
    )
    lists, items = dealt(packed, ["request_id"], ["ids"], catalogue)
    return lists.groupBy("block").cogroup(items.groupBy("block")).applyInArrow(
        _mmr_block(cfg.mmr_lambda, cfg.final_limit), typed(scored, ["request_id", "content_id"], "rank int"))
