"""Visitor clusters over tag affinity: hard (k-means) and soft (fuzzy c-means).

Points stay long (user, key, weight). Centroids are a small wide table (key, c[k]); one
aggregate per visitor gives the distances to all of them, so nothing is paired up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.ordered import top_k
from recspark.operators.persona import entropy_sql
from recspark.functions.labels import sql_text
from recspark.session import cut_lineage


def feature_points(affinity: DataFrame, min_freq: int = 1, max_features: int | None = None) -> DataFrame:
    """Affinity rows of the keys that at least ``min_freq`` visitors carry (most frequent first)."""
    points = affinity.select("user_id", "key", "weight")
    if min_freq <= 1 and not max_features:
        return points
    keys = points.groupBy("key").agg(F.expr("count(*) AS freq")).filter(f"freq >= {min_freq}")
    if max_features:
        keys = keys.orderBy(F.desc("freq"), "key").limit(max_features)
    return points.join(keys.select("key"), "key", "left_semi")


def centroids_of_users(points: DataFrame, users: list[str]) -> DataFrame:
    """Start centroids at given visitors: (key, c[k])."""
    cells = ", ".join(f"coalesce(max(IF(user_id = {sql_text(u)}, weight, NULL)), 0D)" for u in users)
    return points.filter(F.col("user_id").isin(*users)).groupBy("key").agg(F.expr(f"array({cells}) AS c"))


def distances(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(user_id, d2[k]): squared distances as |x|^2 - 2 x.c + |c|^2, never below 0."""
    sizes = centroids.agg(F.expr("array(" + ", ".join(f"coalesce(sum(c[{j}] * c[{j}]), 0D)" for j in range(k)) + ") AS cc")).scalar()
    dots = ", ".join(f"sum(coalesce(weight * c[{j}], 0D))" for j in range(k))
    rows = points.join(centroids, "key", "left").groupBy("user_id").agg(F.expr("sum(weight * weight) AS xx"), F.expr(f"array({dots}) AS dots"))
    cells = ", ".join(f"greatest(xx - 2D * dots[{j}] + cc[{j}], 0D)" for j in range(k))
    return rows.withColumn("cc", sizes).selectExpr("user_id", f"array({cells}) AS d2")


def assign(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """(user_id, cluster, d2): nearest centroid, the lowest number on a tie."""
    return distances(points, centroids, k).selectExpr(
        "user_id", "CAST(array_position(d2, array_min(d2)) - 1 AS INT) AS cluster", "array_min(d2) AS d2"
    )


def lloyd_step(points: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """Centroids after one assign-and-average step; an empty cluster keeps its centroid."""
    labels = assign(points, centroids, k).select("user_id", "cluster")
    counts = labels.agg(F.expr("array(" + ", ".join(f"count_if(cluster = {j})" for j in range(k)) + ") AS n")).scalar()
    sums = ", ".join(f"sum(IF(cluster = {j}, weight, 0D))" for j in range(k))
    totals = points.join(labels, "user_id").groupBy("key").agg(F.expr(f"array({sums}) AS s"))
    cells = ", ".join(f"IF(n[{j}] > 0, coalesce(s[{j}], 0D) / n[{j}], coalesce(c[{j}], 0D))" for j in range(k))
    return totals.join(centroids, "key", "full_outer").withColumn("n", counts).selectExpr("key", f"array({cells}) AS c")


def _moved(old: DataFrame, new: DataFrame, k: int) -> float:
    gap = ", ".join(f"abs(coalesce(a[{j}], 0D) - coalesce(b[{j}], 0D))" for j in range(k))
    both = old.selectExpr("key", "c AS a").join(new.selectExpr("key", "c AS b"), "key", "full_outer")
    return both.agg(F.expr(f"max(greatest({gap}, 0D))")).first()[0] or 0.0


def spread_start(points: DataFrame, k: int, seed: int = 0) -> list[str]:
    """k start visitors drawn with chance proportional to squared distance (k-means++).

    Each draw keeps the smallest of -ln(u)/d2 over the visitors, u a seeded hash: an
    exact weighted draw in one aggregate.
    """
    u = "(CAST(conv(substring(md5(concat(user_id, ':{tag}')), 1, 12), 16, 10) AS BIGINT) + 1) / 281474976710657D"
    chosen = [points.groupBy().agg(F.expr(f"min_by(user_id, {u.format(tag=f'{seed}:0')})")).first()[0]]
    while len(chosen) < k:
        centroids = centroids_of_users(points, chosen)
        near = distances(points, centroids, len(chosen)).selectExpr("user_id", "array_min(d2) AS d2").filter("d2 > 1e-12")
        pick = near.agg(F.expr(f"min_by(user_id, -ln({u.format(tag=f'{seed}:{len(chosen)}')}) / d2)")).first()[0]
        if pick is None:
            break
        chosen.append(pick)
    return chosen


def kmeans(points: DataFrame, k: int, iters: int = 25, seed: int = 0, start: list[str] | None = None) -> tuple[DataFrame, int]:
    """(centroids, k) after Lloyd iterations until nothing moves; k shrinks with few distinct points."""
    users = start or spread_start(points, k, seed)
    k = len(users)
    centroids = cut_lineage(centroids_of_users(points, users))
    for _ in range(iters):
        moved = cut_lineage(lloyd_step(points, centroids, k))
        done = _moved(centroids, moved, k) <= 1e-12
        centroids = moved
        if done:
            break
    return centroids, k


def membership_sql(d2: str, k: int, m: float = 2.0) -> str:
    """Array of soft memberships from squared distances; exact hits share evenly."""
    power = (2.0 / (m - 1.0) if m > 1.0 else 2.0) / 2.0
    ratios = ", ".join(
        "1D / (" + " + ".join(f"pow({d2}[{j}] / {d2}[{i}], {power}D)" for i in range(k)) + ")" for j in range(k)
    )
    hits = f"size(filter({d2}, x -> x < 1e-24D))"
    return f"IF({hits} > 0, transform({d2}, x -> IF(x < 1e-24D, 1D / {hits}, 0D)), array({ratios}))"


def memberships(points: DataFrame, centroids: DataFrame, k: int, m: float = 2.0) -> DataFrame:
    """(user_id, u[k], dominant): soft assignment that sums to 1."""
    soft = distances(points, centroids, k).selectExpr("user_id", f"{membership_sql('d2', k, m)} AS u")
    return soft.selectExpr("user_id", "u", "CAST(array_position(u, array_max(u)) - 1 AS INT) AS dominant")


def fuzzy_centroids(points: DataFrame, soft: DataFrame, k: int, m: float = 2.0) -> DataFrame:
    """Membership-weighted means: (key, c[k])."""
    weighted = soft.selectExpr("user_id", f"transform(u, x -> pow(x, {m}D)) AS w")
    mass = weighted.agg(F.expr("array(" + ", ".join(f"sum(w[{j}])" for j in range(k)) + ") AS den")).scalar()
    sums = ", ".join(f"sum(w[{j}] * weight)" for j in range(k))
    cells = ", ".join(f"coalesce(try_divide(s[{j}], den[{j}]), 0D)" for j in range(k))
    return points.join(weighted, "user_id").groupBy("key").agg(F.expr(f"array({sums}) AS s")).withColumn("den", mass).selectExpr(
        "key", f"array({cells}) AS c"
    )


def fuzzy_cmeans(points: DataFrame, c: int, m: float = 2.0, iters: int = 50, seed: int = 0, tol: float = 1e-4) -> tuple[DataFrame, int]:
    """(centroids, c): from seeded memberships until no membership moves by ``tol``."""
    users = points.select("user_id").distinct()
    c = max(1, min(c, users.count()))
    draw = "(CAST(conv(substring(md5(concat(user_id, ':{j}:{seed}')), 1, 8), 16, 10) AS BIGINT) / 4294967296D + 1e-6D)"
    raw = users.selectExpr("user_id", "array(" + ", ".join(draw.format(j=j, seed=seed) for j in range(c)) + ") AS r")
    soft = raw.selectExpr("user_id", "transform(r, x -> x / aggregate(r, 0D, (a, y) -> a + y)) AS u")
    centroids = cut_lineage(fuzzy_centroids(points, soft, c, m))
    for _ in range(iters - 1):
        moved = cut_lineage(fuzzy_centroids(points, memberships(points, centroids, c, m), c, m))
        before = memberships(points, centroids, c, m).selectExpr("user_id", "u AS a")
        after = memberships(points, moved, c, m).selectExpr("user_id", "u AS b")
        gap = before.join(after, "user_id").agg(F.expr("max(array_max(zip_with(a, b, (x, y) -> abs(x - y))))")).first()[0]
        centroids = moved
        if gap is None or gap < tol:
            break
    return centroids, c


def long_centroids(centroids: DataFrame) -> DataFrame:
    """(cluster, key, weight) of the non-zero centroid cells."""
    return centroids.selectExpr("key", "posexplode(c) AS (cluster, weight)").filter("weight > 0")


def shared_tags(points: DataFrame, labels: DataFrame, centroids: DataFrame, top: int = 5) -> DataFrame:
    """(user_id, rank, key): keys a visitor shares with its cluster, by the smaller weight."""
    cells = long_centroids(centroids).selectExpr("cluster", "key", "weight AS c")
    both = points.filter("weight > 0").join(labels.select("user_id", "cluster"), "user_id").join(cells, ["cluster", "key"])
    ranked = both.selectExpr("user_id", "cluster", "key", "least(weight, c) AS shared")
    return top_k(ranked, ["user_id"], [F.expr("round(shared, 9)").desc(), F.col("key")], top, rank="rank").select("user_id", "cluster", "rank", "key")


# Fixed value: a visitor whose strongest membership is below this stands between clusters.
SPLIT_BELOW = 0.65


def compare(hard: DataFrame, soft: DataFrame) -> DataFrame:
    """(user_id, cluster, dominant, strongest, split): the hard cluster of each visitor beside its soft ones.

    hard: user_id, cluster; soft: user_id, u, dominant as `memberships` gives them.
    """
    both = hard.select("user_id", "cluster").join(soft.selectExpr("user_id", "dominant", "array_max(u) AS strongest"), "user_id")
    return both.selectExpr("user_id", "cluster", "dominant", "strongest", f"strongest < {SPLIT_BELOW}D AS split")


def contingency(hard: DataFrame, soft: DataFrame) -> DataFrame:
    """(cluster, soft_cluster, n, mass): visitors of a hard cluster whose dominant soft one this is, and all their membership in it.

    One aggregate over the memberships; the result has a row for each pair of clusters.
    """
    rows = hard.select("user_id", "cluster").join(soft, "user_id").selectExpr("cluster", "dominant", "posexplode(u) AS (soft_cluster, membership)")
    return rows.groupBy("cluster", "soft_cluster").agg(F.expr("count_if(dominant = soft_cluster) AS n"), F.expr("sum(membership) AS mass"))


def agreement(table: DataFrame) -> DataFrame:
    """One row from a contingency table: visitors, Rand index adjusted for chance, purity, and the same of the soft masses.

    The adjusted index is 1 for equal groupings, about 0 for unrelated ones, and 1 where neither grouping separates any pair or both separate all.
    """
    def pairs(n: str) -> str:
        return f"sum({n} * ({n} - 1) / 2D)"

    cells = table.agg(F.expr("CAST(sum(n) AS BIGINT) AS visitors"), F.expr(f"{pairs('n')} AS together"))
    by = [table.groupBy(c).agg(F.expr("sum(n) AS n"), F.expr("max(n) AS most"), F.expr("max(mass) AS most_mass"), F.expr("sum(mass) AS mass")).agg(
        F.expr(f"{pairs('n')} AS pairs_{c}"), F.expr(f"sum(most) AS pure_{c}"), F.expr(f"sum(most_mass) / sum(mass) AS overlap_{c}")) for c in ("cluster", "soft_cluster")]
    one = cells.crossJoin(F.broadcast(by[0])).crossJoin(F.broadcast(by[1]))  # one row each
    chance = "pairs_cluster * pairs_soft_cluster / nullif(visitors * (visitors - 1) / 2D, 0D)"
    return one.selectExpr(
        "visitors", f"coalesce(try_divide(together - {chance}, (pairs_cluster + pairs_soft_cluster) / 2D - {chance}), 1D) AS adjusted_rand",
        "pure_cluster / visitors AS purity", "overlap_cluster AS soft_overlap")


def profiles(labels: DataFrame, centroids: DataFrame, k: int, top: int = 5, members_shown: int = 50) -> DataFrame:
    """One row per cluster: size, strongest tags, breadth with its reading, first members; ``labels`` has all of them."""
    cells = long_centroids(centroids)
    best = top_k(cells, ["cluster"], [F.expr("round(weight, 9)").desc(), F.col("key")], top, rank="rank")
    tags = best.groupBy("cluster").agg(F.expr("transform(array_sort(collect_list(struct(rank, key, weight))), x -> struct(x.key, x.weight)) AS top_tags"))
    theme = "IF(startswith(key, 'theme_what'), weight, NULL)"
    has_theme = centroids.agg(F.expr("coalesce(bool_or(startswith(key, 'theme_what')), false)")).scalar()
    spread = cells.groupBy("cluster").agg(F.expr(f"{entropy_sql(theme)} AS by_theme"), F.expr(f"{entropy_sql('weight')} AS by_key"))
    sizes = labels.groupBy("cluster").agg(F.expr("count(*) AS size"))
    members = top_k(labels.select("cluster", "user_id"), ["cluster"], [F.col("user_id")], members_shown).groupBy("cluster").agg(
        F.expr("array_sort(collect_list(user_id)) AS members")
    )
    rows = spread.withColumn("has_theme", has_theme).selectExpr("cluster", "IF(has_theme, by_theme, by_key) AS breadth")
    out = labels.sparkSession.range(k).selectExpr("CAST(id AS INT) AS cluster").join(rows, "cluster", "left").join(sizes, "cluster", "left")
    hint = "CASE WHEN breadth >= 0.6 THEN 'Explorer-like (broad)' WHEN breadth <= 0.3 THEN 'Hobbyist-like (narrow)' ELSE 'Mixed' END"
    return out.join(tags, "cluster", "left").join(members, "cluster", "left").selectExpr(
        "cluster", "coalesce(size, 0) AS size", "top_tags", "coalesce(breadth, 0D) AS breadth", f"{hint} AS falk_hint", "members"
    )
