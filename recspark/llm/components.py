"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.session import cut_lineage


def _rewired(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the larger (smaller) neighbours of each node on the smallest node it knows.

    The smallest neighbour is a plain minimum, combined before the shuffle, and is joined back, so that a node with very
    many neighbours is split by adaptive execution instead of meeting in one window.
    """
    ways = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = ways.join(least, "a")
    out = met.where("b > a" if not small else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if small:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another node; root is the smallest node of its component.

    Edges may repeat, point either way or be loops; edges with a null end are no edges. Rounds go on until nothing
    changes, and each round's edges are checkpointed.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and a <> b").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        larger = cut_lineage(_rewired(edges, small=False))
        edges = cut_lineage(_rewired(larger, small=True))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = tuple(now)
