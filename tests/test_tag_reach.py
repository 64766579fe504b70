from collections import Counter

from recspark.operators import candidates as cg


def test_tag_sets_give_few_items_and_all_that_count(spark):
    """100 tag sets of 40 items each, all met by one key set at two scores: not 100 times `need` rows."""
    items = [(f"c{n:05d}", f"p{n * 7919 % 100:02d}") for n in range(4000)]
    met = [(who, f"p{p:02d}", float(2 if p < few else 1), need) for who, few, need in (("a", 3, 30), ("b", 0, 30), ("c", 1, 55)) for p in range(100)]
    profile = spark.createDataFrame(items, "content_id string, profile string")
    sets = spark.createDataFrame(met, "keyset string, profile string, base_score double, need int")
    score = {(k, p): s for k, p, s, _ in met}
    for most, asked in ((None, sets), (30, sets.filter("need = 30"))):
        found = [tuple(r)[:3] for r in cg._reach(asked, profile, "keyset", "profile", most).collect()]
        for who, need in (("a", 30), ("b", 30), ("c", 55)):
            if most and need != most:
                continue
            best = sorted((-score[who, p], i) for i, p in items)[:need]
            assert best == sorted((-s, i) for k, i, s in found if k == who)[:need]
        assert max(Counter(k for k, *_ in found).values()) <= 30 * 31 / 2 if most else 55 * 56 / 2
