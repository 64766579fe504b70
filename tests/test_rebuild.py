from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from world import NOW, catalogue, events, view

from recspark.config import RecConfig
from recspark.operators import rebuild as rb
from recspark.operators.signals import VisitorModel
from recspark.sources import logs


def visits(spark):
    rows = view("u1", "101", 40, "next_button", hours=50) + view("u1", "102", 3, "abandon", hours=30) + view("u1", "101", 20, "link", hours=2)
    rows += view("u2", "201", 40, "next_button", hours=5, visits=3, impressions=["201", "202", "301"])
    answers = {"interest": ["5"], "age_group": ["25_34"], "gender": ["female"]}
    rows += [("u2", "IDENTIFY", NOW - timedelta(hours=60), None, None, None, [], answers), ("u2", "IDENTIFY", NOW - timedelta(hours=1), None, None, None, [], {"gender": ["male"]})]
    return events(spark, rows).withColumn("raw", F.col("event_id").cast("string"))


def tables(model):
    """All keyed tables as plain values, doubles at nine digits."""
    out = {}
    for name in ("signals", "negatives", "tag_affinity", "tag_aversion", "demographics", "users", "taste"):
        df = getattr(model, name)
        out[name] = sorted((tuple(round(v, 9) if isinstance(v, float) else [round(x, 9) for x in v] if isinstance(v, list) else v for v in r) for r in df.select(sorted(df.columns)).distinct().collect()), key=str)
    return out


def logged(spark, state, tenant="default"):
    c = catalogue(spark)
    return rb.LoggedModel(spark, state, c.contents, c.tags, c.vectors, NOW, RecConfig(), tenant=tenant)


def test_rebuilds_by_batches_equal_one_model_of_all_events(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    all_events, c = visits(spark), catalogue(spark)
    want = tables(VisitorModel(all_events, c.contents, c.tags, c.vectors, NOW, RecConfig()))
    assert rb.rebuild(spark, *_touched(spark, log, state, all_events.filter("event_id % 2 = 1"), "odd")) == 0
    # late and repeated: the other events and two that are known already
    assert rb.rebuild(spark, *_touched(spark, log, state, all_events.filter("event_id % 2 = 0 OR event_id IN (1, 7)"), "even")) == 1
    assert tables(logged(spark, state)) == want
    assert rb.rebuild(spark, log, state) == 1  # nothing new
    assert rb.rebuild(spark, *_touched(spark, log, state, all_events, "again")) == 2
    assert tables(logged(spark, state)) == want
    once = str(tmp_path / "once")
    assert rb.rebuild(spark, log, once) == 0 and tables(logged(spark, once)) == want


def _touched(spark, log, state, rows, batch):
    logs.append_events(rows, log, batch=batch)
    return log, state


def test_a_failed_rebuild_leaves_nothing_and_parts_are_combined(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    rows = visits(spark)
    for n in range(3):
        rb.rebuild(spark, *_touched(spark, log, state, rows.filter(f"event_id % 3 = {n}"), f"b{n}"), most_parts=2)
    assert rb._live(spark, state) == [2]  # the third holds the first two
    want = tables(logged(spark, state))
    # parts of a rebuild that never committed, and a commit folder without its mark
    for kind in rb.KINDS:
        rb._parts(spark, state, kind, [2]).write.partitionBy("tenant").parquet(f"{state}/{kind}/version=3")
    (tmp_path / "state/commits/version=3").mkdir()
    assert tables(logged(spark, state)) == want
    assert rb.rebuild(spark, *_touched(spark, log, state, rows.filter("event_id = 0").withColumn("raw", F.lit("new")), "b3")) == 3
    assert rb.states(spark, state, "people", "default").agg(F.sum("events")).first()[0] == rows.count() + 1


def test_a_batch_that_changed_after_it_was_folded_is_an_error(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    rows = visits(spark)
    rb.rebuild(spark, *_touched(spark, log, state, rows.filter("event_id < 1"), "one"))
    logs.append_events(rows.filter("event_id < 2"), log, batch="one")
    with pytest.raises(ValueError, match="rebuild from the start"):
        rb.rebuild(spark, log, state)


def test_only_new_days_of_the_tenant_are_read(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    rows = visits(spark)
    for tenant in ("camp", "town"):
        logs.append_events(rows.filter("ts < '2026-06-10'"), log, tenant, batch="old")
    rb.rebuild(spark, log, state)
    logs.append_events(rows.filter("ts >= '2026-06-10'"), log, "town", batch="new")
    batches = rb.new_batches(spark, log, state, "town")
    assert {(r.tenant, str(r.date)) for r in batches.collect()} == {("town", "2026-06-10")}
    plan = rb.unfolded_events(spark, log, batches, rb.folded_batches(spark, state), "town")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan parquet" in line and "event_key" in line]
    assert scans and all("PartitionFilters" in s and "(tenant" in s and "(date" in s for s in scans)
    rb.rebuild(spark, log, state, tenant="town")
    assert rb.states(spark, state, "people", "camp").agg(F.sum("events")).first()[0] == rows.filter("ts < '2026-06-10'").count()
    c = catalogue(spark)
    assert tables(logged(spark, state, "town")) == tables(VisitorModel(rows, c.contents, c.tags, c.vectors, NOW, RecConfig()))


def test_ids_of_tenants_never_meet(spark):
    rows = spark.createDataFrame([("a", "b1", "x"), ("ab", "1", None), ("a", None, "y")], "tenant string, user_id string, content_id string")
    both = rb.scoped(rows, "user_id", "content_id")
    assert both.select("user_id").distinct().count() == 3
    back = rb.unscoped(both.filter("user_id IS NOT NULL").drop("tenant"), "user_id", "content_id")
    assert sorted((tuple(r) for r in back.collect()), key=str) == [("a", "b1", "x"), ("ab", "1", None)]


def test_empty_state(spark, tmp_path):
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    logs.append_events(visits(spark).limit(0), log, batch="none")
    (tmp_path / "log/events").mkdir(parents=True, exist_ok=True)
    assert rb.rebuild(spark, log, state) is None
    assert tables(logged(spark, state))["signals"] == []
