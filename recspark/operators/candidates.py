"""Candidate generation for many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.config import RecConfig
from recspark.functions.labels import decode_machine_tag, with_norm_label
from recspark.functions.ordered import global_position, top_k
from recspark.functions.vectors import haversine_m
from recspark.operators.knn import nearest
from recspark.session import materialize

# Grid levels of the radius search: cells of 180 degrees down to about 10 metres.
LEVELS = 21
METRES_PER_DEGREE = 111_194.0


def _known(seen: DataFrame) -> DataFrame:
    """(user_id, extra): how many items each user has seen."""
    return seen.select("user_id", "content_id").distinct().groupBy("user_id").agg(F.expr("CAST(count(*) AS INT) AS extra"))


def semantic_recall(taste: DataFrame, vectors: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """(user_id, content_id, base_score): the k items nearest to each taste vector, of the unseen ones if ``seen`` is given."""
    if seen is None:
        hits = nearest(taste.selectExpr("user_id AS qid", "taste AS qvec"), vectors, k)
        return hits.selectExpr("qid AS user_id", "content_id", "score AS base_score")
    asked = taste.join(_known(seen), "user_id", "left").selectExpr("user_id AS qid", "taste AS qvec", "coalesce(extra, 0) AS extra")
    hits = nearest(asked, vectors, k).selectExpr("qid AS user_id", "content_id", "score AS base_score")
    fresh = hits.join(seen, ["user_id", "content_id"], "left_anti")
    return top_k(fresh, ["user_id"], [F.desc("base_score"), F.col("content_id")], k).select("user_id", "content_id", "base_score")


def top_keys(affinity: DataFrame, n: int) -> DataFrame:
    """(user_id, nkey): canonical form of each user's n strongest tag keys."""
    order = [F.expr("round(weight, 9)").desc(), F.col("key")]
    return top_k(affinity, ["user_id"], order, n).select("user_id", "nkey").distinct()


# Keys that more different tag sets carry than this are frequent: sets meet by the others, and by frequent keys only as
# what is left of them when the others are taken away.
FREQUENT_SETS = 1024


def tag_recall(affinity: DataFrame, tags_nkey: DataFrame, cfg: RecConfig, seen: DataFrame | None = None, frequent: int = FREQUENT_SETS) -> DataFrame:
    """(user_id, content_id, base_score): items sharing most of the user's top keys.

    Overlap depends only on the user's key set and the item's tag set, so both sides are
    reduced to distinct sets first. Of one tag set only the k lowest ids can ever reach a
    top k (same overlap, ties by id); a tag carried by a third of the catalogue therefore
    costs one row per tag set, not one per item. With ``seen``, seen items leave before the
    cut: k more rows than the most that a user of the key set has seen are then enough. What
    frequent tags cost is bounded too (`_best_overlaps`), and tag sets give only the items that can be
    among those rows (`_reach`).
    """
    k = cfg.pool_per_generator
    keyset = materialize(
        top_keys(affinity, cfg.tag_keys_per_user)
        .groupBy("user_id")
        .agg(F.expr("array_sort(collect_list(nkey)) AS keys"))
        .selectExpr("user_id", "keys", "unhex(md5(concat_ws('\\n', keys))) AS keyset")
    )
    profile = materialize(tags_nkey.groupBy("content_id").agg(F.expr("array_sort(collect_set(nkey)) AS keys")).selectExpr(
        "content_id", "keys", "unhex(md5(concat_ws('\\n', keys))) AS profile"
    ))
    if seen is not None:
        return _unseen_tag_recall(keyset, profile, seen, k, frequent)
    sets = keyset.groupBy("keyset").agg(F.expr("any_value(keys) AS keys")).withColumn("need", F.lit(k))
    best = _best_overlaps(sets, profile, frequent, k)
    return keyset.select("user_id", "keyset").join(best, "keyset").select("user_id", "content_id", "base_score")


def _overlaps(wanted: DataFrame, carried: DataFrame, one: str, other: str) -> DataFrame:
    """(one, other, shared): shared keys of each pair of different sets, both given as (set, nkey)."""
    return wanted.join(carried, "nkey").groupBy(one, other).agg(F.expr("count(*) AS shared"))


def _ranked(found: DataFrame, group: str, most: int | None) -> DataFrame:
    """The first `need` rows of each group, and `most` of them where that is one number: then each map task cuts its own rows."""
    order = [F.col("base_score").desc(), F.col("content_id")]
    if most is not None:
        return top_k(found, [group], order, most)
    ranked = found.withColumn("_rank", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY base_score DESC, content_id)"))
    return ranked.filter("_rank <= need").drop("_rank")


def _reach(met: DataFrame, profile: DataFrame, one: str, group: str, most: int | None) -> DataFrame:
    """(one, content_id, base_score, need): the items of the sets met that can be among the `need` first of `one`.

    met: one, group, base_score (whole numbers), need; profile: group, content_id. Sets are taken by their score, then their
    lowest id. All items of sets with a higher score come before an item, and the lowest ids of the sets before its own with the
    same score, and the items of its own set with lower ids; where these are `need` already, it is not read.
    """
    heads = profile.groupBy(group).agg(F.expr("min(struct(content_id)) AS head"), F.expr("count(*) AS n_items"))
    order = [F.col("base_score").desc(), F.col("head")]
    sets = met.join(heads, group)
    if most is not None:
        sets = top_k(sets, [one], order, most)
    else:
        sets = sets.withColumn("_rank", F.row_number().over(Window.partitionBy(one).orderBy(*order))).filter("_rank <= need").drop("_rank")
    sets = sets.selectExpr(
        one, group, "base_score", "need",
        f"coalesce(sum(n_items) OVER (PARTITION BY {one} ORDER BY CAST(-base_score AS BIGINT) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS above",
        f"row_number() OVER (PARTITION BY {one}, base_score ORDER BY head) AS turn",
    ).selectExpr(one, group, "base_score", "need", "need - above - turn + 1 AS slots").filter("slots > 0")
    return sets.join(_members(profile, group, most), group).filter("place <= slots").select(one, "content_id", "base_score", "need")


def _members(profile: DataFrame, group: str, most: int | None) -> DataFrame:
    """(group, content_id, place): items of a set from the lowest id on."""
    if most is not None:
        return top_k(profile.select(group, "content_id"), [group], [F.col("content_id")], most, rank="place")
    return profile.select(group, "content_id", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY content_id) AS place"))


def _best_overlaps(sets: DataFrame, profile: DataFrame, frequent: int, most: int | None = None) -> DataFrame:
    """(keyset, content_id, base_score): the `need` items that share most keys with each set, ties by id.

    sets: keyset, keys, need; profile: content_id, keys, profile. Sets that share a key carried by at most `frequent`
    different tag sets meet by it, and their overlap is counted in full: so many rows a key at most. What shares
    frequent keys only is found among the sets' frequent parts, of which there are few: an item that `need` others beat by
    frequent keys alone, they beat in full too. With one tag on a third of all items that part is with it or without.
    """
    carried = profile.groupBy("profile").agg(F.expr("any_value(keys) AS keys")).selectExpr("profile", "explode(keys) AS nkey")
    wanted = sets.selectExpr("keyset", "explode(keys) AS nkey")
    often = carried.groupBy("nkey").agg(F.expr("count(*) AS n")).filter(F.col("n") > frequent).select("nkey")
    if often.isEmpty():
        met = _overlaps(wanted, carried, "keyset", "profile").selectExpr("keyset", "profile", "CAST(shared AS DOUBLE) AS base_score")
        found = _reach(met.join(sets.select("keyset", "need"), "keyset"), profile, "keyset", "profile", most)
        return _ranked(found, "keyset", most).select("keyset", "content_id", "base_score")
    often = materialize(often)

    def part(rows: DataFrame, key: str, name: str) -> DataFrame:
        """Each set with the id and the keys of its frequent part."""
        held = rows.join(often, "nkey").groupBy(key).agg(F.expr("array_sort(collect_list(nkey)) AS keys"))
        return materialize(held.selectExpr(key, f"keys AS {name}_keys", f"unhex(md5(concat_ws('\\n', keys))) AS {name}"))

    asked, offered = part(wanted, "keyset", "ask"), part(carried, "profile", "offer")
    none = "CAST(array() AS ARRAY<STRING>)"
    rare = _overlaps(wanted.join(often, "nkey", "left_anti"), carried.join(often, "nkey", "left_anti"), "keyset", "profile")
    full = rare.join(asked, "keyset", "left").join(offered, "profile", "left").selectExpr(
        "keyset", "profile", f"CAST(shared + size(array_intersect(coalesce(ask_keys, {none}), coalesce(offer_keys, {none}))) AS DOUBLE) AS base_score")
    by_rare = _reach(full.join(sets.select("keyset", "need"), "keyset"), profile, "keyset", "profile", most)
    needs = asked.join(sets, "keyset").groupBy("ask").agg(F.expr("max(need) AS need"))
    ask_keys = asked.groupBy("ask").agg(F.expr("any_value(ask_keys) AS keys")).selectExpr("ask", "explode(keys) AS nkey")
    offer_keys = offered.groupBy("offer").agg(F.expr("any_value(offer_keys) AS keys")).selectExpr("offer", "explode(keys) AS nkey")
    members = profile.join(offered.select("profile", "offer"), "profile").select("offer", "content_id")
    met = _overlaps(ask_keys, offer_keys, "ask", "offer").join(needs, "ask").selectExpr("ask", "offer", "CAST(shared AS DOUBLE) AS base_score", "need")
    common = _ranked(_reach(met, members, "ask", "offer", most), "ask", most).drop("need")
    by_often = common.join(asked.select("keyset", "ask"), "ask").join(sets.select("keyset", "need"), "keyset")
    columns = ["keyset", "content_id", "base_score", "need"]
    both = by_rare.select(*columns).unionByName(by_often.select(*columns)).groupBy("keyset", "content_id", "need").agg(F.expr("max(base_score) AS base_score"))
    return _ranked(both, "keyset", most).select("keyset", "content_id", "base_score")


def _unseen_tag_recall(keyset: DataFrame, profile: DataFrame, seen: DataFrame, k: int, frequent: int) -> DataFrame:
    sets = keyset.join(_known(seen), "user_id", "left").groupBy("keyset").agg(F.expr("any_value(keys) AS keys"), F.expr(f"{k} + coalesce(max(extra), 0) AS need"))
    best = _best_overlaps(sets, profile, frequent)
    fresh = keyset.select("user_id", "keyset").join(best, "keyset").join(seen, ["user_id", "content_id"], "left_anti")
    return top_k(fresh, ["user_id"], [F.desc("base_score"), F.col("content_id")], k).select("user_id", "content_id", "base_score")


def filter_values(tags: DataFrame) -> DataFrame:
    """(content_id, value): canonical tag values that a location filter is compared with."""
    decoded = tags.selectExpr("content_id", f"{decode_machine_tag('label')} AS label")
    return with_norm_label(decoded, "label", "value").select("content_id", "value").distinct()


def value_positions(values: DataFrame) -> DataFrame:
    """(value, content_id, position): 1-based places by id within each value.

    Rows are sorted in ranges of (value, id), which cut a frequent value into several, and the rows of a value in the
    ranges before are added; the ranges are written first, so that all readers see the same ones.
    """
    ranges = materialize(values.select("value", "content_id").distinct().repartitionByRange("value", "content_id").withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("value", "_range").agg(F.expr("count(*) AS n"))
    before = counts.selectExpr("value", "_range", "coalesce(sum(n) OVER (PARTITION BY value ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS n_before")
    inside = ranges.selectExpr("value", "content_id", "_range", "row_number() OVER (PARTITION BY value, _range ORDER BY content_id) AS place")
    return inside.join(before, ["value", "_range"]).selectExpr("value", "content_id", "place + n_before AS position")


def filter_recall(requests: DataFrame, values: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """(request_id, content_id): the first k items (by id) with the requested tag value.

    With m seen items of that value, the first k unseen ones are among the first k + m: a
    request asks for those positions, and the equi join on (value, position) reads no others.
    """
    ranked = value_positions(values)
    asked = requests.selectExpr("request_id", "user_id", f"{decode_machine_tag('filter')} AS label")
    asked = with_norm_label(asked, "label", "value").select("request_id", "user_id", "value")
    if seen is None:
        wanted = asked.selectExpr("request_id", "value", f"explode(sequence(1L, {k}L)) AS position")
        return wanted.join(ranked, ["value", "position"]).select("request_id", "content_id")
    blocked = seen.join(values, "content_id").groupBy("user_id", "value").agg(F.expr("count(*) AS m"))
    wide = asked.join(blocked, ["user_id", "value"], "left").selectExpr("request_id", "user_id", "value", f"explode(sequence(1L, {k}L + coalesce(m, 0L))) AS position")
    unseen = wide.join(ranked, ["value", "position"]).join(seen, ["user_id", "content_id"], "left_anti")
    return top_k(unseen, ["request_id"], [F.col("content_id")], k).select("request_id", "content_id")


def in_radius(requests: DataFrame, places: DataFrame) -> DataFrame:
    """(request columns, content_id, distance_m) of the items inside each request's radius.

    There are grids of all levels, each with cells half as wide as the one before. A request uses the level whose cells
    are about as wide as its radius, and is repeated for the few of them its bounding box touches (longitudes wrap); an item
    is repeated for the levels in use, LEVELS + 1 at most. So the join is an equi join, whose cells hold no much wider area
    than the radius asks for, with an exact test after it.
    """
    columns = requests.columns
    requests = requests.withColumn("level", F.expr(
        f"CAST(greatest(0, least({LEVELS}, floor(log2(180D * {METRES_PER_DEGREE}D / greatest(radius_m, 1D))))) AS INT)"))
    cell, around = "(180D / pow(2D, level))", "CAST(2 * pow(2D, level) AS INT)"
    used = ", ".join(str(r[0]) for r in requests.select("level").distinct().collect() if r[0] is not None) or "0"  # LEVELS + 1 at most
    box = requests.selectExpr(
        *columns, "level",
        f"radius_m / {METRES_PER_DEGREE}D AS dlat",
        f"least(180D, radius_m / {METRES_PER_DEGREE}D / greatest(cos(radians(least(abs(lat) + radius_m / {METRES_PER_DEGREE}D, 90D))), 1e-9D)) AS dlon",
    )
    cells = box.selectExpr(
        *columns, "level", "dlon",
        f"explode(sequence(CAST(floor((lat - dlat + 90) / {cell}) AS INT), CAST(floor((lat + dlat + 90) / {cell}) AS INT))) AS cy",
    ).selectExpr(
        *columns, "level", "cy",
        f"explode(array_distinct(transform(sequence(CAST(floor((lon - dlon + 180) / {cell}) AS INT), "
        f"CAST(floor((lon + dlon + 180) / {cell}) AS INT)), x -> pmod(x, {around})))) AS cx",
    ).filter("cy BETWEEN 0 AND CAST(pow(2D, level) AS INT)")
    items = places.filter("lat IS NOT NULL AND lon IS NOT NULL").selectExpr("content_id", "lat", "lon", f"explode(array({used})) AS level").selectExpr(
        "content_id", "lat AS item_lat", "lon AS item_lon", "level",
        f"CAST(floor((lat + 90) / {cell}) AS INT) AS cy",
        f"pmod(CAST(floor((lon + 180) / {cell}) AS INT), {around}) AS cx",
    )
    near = cells.join(items, ["level", "cy", "cx"]).selectExpr(
        *columns, "content_id", f"{haversine_m('lat', 'lon', 'item_lat', 'item_lon')} AS distance_m"
    )
    return near.filter("distance_m <= radius_m")


def filtered_geo_recall(requests: DataFrame, values: DataFrame, places: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """(request_id, content_id): of the (unseen) items with the requested tag value inside the radius, the k nearest.

    Both conditions hold before the cut, so no item that satisfies them is lost to one that satisfies one only.
    """
    asked = with_norm_label(requests.selectExpr("*", f"{decode_machine_tag('filter')} AS label"), "label", "value")
    near = in_radius(asked.select("request_id", "user_id", "value", "lat", "lon", "radius_m"), places)
    both = near.join(values, ["content_id", "value"], "left_semi")
    if seen is not None:
        both = both.join(seen, ["user_id", "content_id"], "left_anti")
    return top_k(both, ["request_id"], [F.col("distance_m"), F.col("content_id")], k).select("request_id", "content_id")


def geo_recall(requests: DataFrame, places: DataFrame, seen: DataFrame | None, k: int) -> DataFrame:
    """(request_id, content_id, base_score): the k nearest (unseen) items inside the radius."""
    near = in_radius(requests.select("request_id", "user_id", "lat", "lon", "radius_m"), places)
    if seen is not None:
        near = near.join(seen, ["user_id", "content_id"], "left_anti")
    best = top_k(near, ["request_id"], [F.col("distance_m"), F.col("content_id")], k)
    return best.selectExpr("request_id", "content_id", "-distance_m AS base_score")


def sample_order(contents: DataFrame, seed: int) -> DataFrame:
    """(content_id, position): one fixed pseudo-random order of the whole catalogue."""
    key = F.expr(f"md5(concat(content_id, ':{seed}'))")
    return global_position(contents.select("content_id"), key, "content_id").selectExpr("content_id", "position")


def sample_outside(keys: DataFrame, excluded: DataFrame, order: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """(key, content_id, draw): the first n catalogue items outside each key's excluded set.

    A key with m excluded items finds its n items among the first n + m positions.
    """
    blocked = excluded.select(key, "content_id").distinct()
    counts = blocked.groupBy(key).agg(F.expr("count(*) AS m"))
    wide = keys.select(key).distinct().join(counts, key, "left").selectExpr(
        key, f"explode(sequence(1L, {n}L + coalesce(m, 0L))) AS position"
    )
    drawn = wide.join(order, "position").join(blocked, [key, "content_id"], "left_anti")
    return top_k(drawn, [key], [F.col("position")], n, rank="draw").select(key, "content_id", "draw")
