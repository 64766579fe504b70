import re

from recspark.operators.persona import interests


def test_evidence_comes_from_the_visitors_items(spark):
    """A key that many items carry: the visitors' own items lead to it, it doesn't lead to all that carry it."""
    tags = spark.createDataFrame([(f"c{n:02d}", k) for n in range(40) for k in ("Theme:Hot", f"Place:{n % 3}")], "content_id string, key string")
    weights = spark.createDataFrame([("u", "theme:hot", 2.0), ("u", "place:1", 1.0), ("v", "theme:hot", 1.0), ("w", "place:0", 1.0)], "user_id string, key string, weight double")
    items = spark.createDataFrame([("u", f"c{n:02d}", float(n)) for n in range(8)] + [("v", "c01", 1.0), ("v", "gone", 1.0)], "user_id string, content_id string, weight double")
    out = interests(weights, items, tags)
    got = {(r.user_id, r["rank"]): (r.facet, r.label, r.evidence) for r in out.collect()}
    assert got == {
        ("u", 1): ("theme", "hot", ["c07", "c06", "c05", "c04", "c03"]), ("u", 2): ("place", "1", ["c07", "c04", "c01"]),
        ("v", 1): ("theme", "hot", ["c01"]), ("w", 1): ("place", "0", []),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner, \(key#\d+ = key#\d+\)", plan)
