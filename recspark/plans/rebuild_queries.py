"""Queries of the models that are rebuilt from the durable log, batch by batch and for several tenants."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from recspark.operators.rebuild import LoggedModel, rebuild, scoped, unscoped
from recspark.plans import bindings as b
from recspark.plans.oracle import CTES, cte
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import CFG, World
from recspark.session import run_folder
from recspark.sources import logs


def _folders(spark) -> tuple[str, str]:
    base = f"{run_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    return f"{base}/log", f"{base}/state"


def _weights(model):
    """(kind, user_id, key, weight) of the model's keyed tables."""
    tables = {"signal": model.signals.filter("weight IS NOT NULL").withColumnRenamed("content_id", "key"), "affinity": model.tag_affinity,
              "aversion": model.tag_aversion, "negative": model.negatives.withColumnRenamed("content_id", "key")}
    out = None
    for kind, rows in tables.items():
        rows = rows.select(F.lit(kind).alias("kind"), "user_id", "key", "weight")
        out = rows if out is None else out.unionByName(rows)
    return out


WEIGHTS = """
SELECT 'signal' AS kind, user_id, content_id AS key, CASE outcome WHEN 'positive' THEN greatest(strength, 0.0) * decay ELSE abs(strength) * decay END AS weight FROM scored_views WHERE outcome <> 'neutral'
UNION ALL SELECT 'affinity', user_id, key, weight FROM affinity UNION ALL SELECT 'aversion', user_id, key, weight FROM aversion
UNION ALL SELECT 'negative', user_id, content_id, weight FROM neg_items
"""
cte("model_weights", WEIGHTS)


@query("rebuilt_models", "SELECT kind, user_id, key, round(weight, 6) AS weight FROM model_weights")
def rebuilt_models(spark, sf_dir):
    """The log comes in three cuts that overlap in days and deliveries; each is folded into the models of those before it."""
    w = World(spark, sf_dir)
    log, state = _folders(spark)
    events = w.events.withColumn("raw", F.col("event_id").cast("string"))
    for cut in range(3):
        logs.append_events(events.filter(f"event_id % 3 = {cut} OR (event_id % 7 = 0 AND event_id % 3 < {cut})"), log, batch=f"cut-{cut}")
        rebuild(spark, log, state, most_parts=2)
    return _weights(LoggedModel(spark, state, w.contents, w.content_tags, w.vectors, b.NOW, CFG, w.provider, tenant="default")).selectExpr(
        "kind", "user_id", "key", *r6("weight"))


# The same sub-queries over the events of the second tenant: every other event of the same visitors.
cte("iev_half", "SELECT * FROM iev WHERE event_id % 2 = 0")
HALF = ["iev", "views_agg", "scored_views", "pos_items", "neg_explicit", "neg_soft", "neg_items", "identified", "survey_tags", "demo_survey", "demo", "demo_tags", "affinity", "aversion", "model_weights"]
for _name in HALF[1:]:
    cte(f"{_name}_half", re.sub(rf"\b(FROM|JOIN) ({'|'.join(HALF)})\b", r"\1 \2_half", CTES[_name]))


@query("tenant_models", """
SELECT 'camp' AS tenant, kind, user_id, key, round(weight, 6) AS weight FROM model_weights
UNION ALL SELECT 'town', kind, user_id, key, round(weight, 6) FROM model_weights_half
""")
def tenant_models(spark, sf_dir):
    """Two tenants with the same visitor and item ids: one job, models keyed by both, and nothing of one in the other."""
    w = World(spark, sf_dir)
    log, state = _folders(spark)
    events = w.events.withColumn("raw", F.col("event_id").cast("string"))
    logs.append_events(events, log, "camp", batch="one")
    rebuild(spark, log, state)
    logs.append_events(events.filter("event_id % 2 = 0"), log, "town", batch="one")
    rebuild(spark, log, state, tenant="town")
    both = spark.createDataFrame([("camp",), ("town",)], "tenant string")

    def of_both(df, *ids):
        return scoped(df.crossJoin(F.broadcast(both)), *ids).drop("tenant")

    model = LoggedModel(spark, state, of_both(w.contents, "content_id"), of_both(w.content_tags, "content_id"), of_both(w.vectors, "content_id"), b.NOW, CFG, of_both(w.provider, "user_id"))
    rows = unscoped(_weights(model), "user_id")
    # Signals and negatives are keyed by an item, which carries its tenant too.
    return rows.withColumn("key", F.expr("IF(kind IN ('signal', 'negative'), substring(key, instr(key, char(31)) + 1), key)")).selectExpr("tenant", "kind", "user_id", "key", *r6("weight"))
