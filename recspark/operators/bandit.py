"""Linear contextual bandit: rewards, samples, sufficient statistics, policy and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.config import FEATURES, RecConfig
from recspark.functions import engagement as eng
from recspark.functions.ordered import global_position
from recspark.session import materialize

D = len(FEATURES)
NOMINAL_WORDS = 150  # fixed value: the logs carry no word counts
STATE_COLUMNS = ("a", "b", "n_updates", "ridge")


def impression_rewards(events: DataFrame, cfg: RecConfig) -> DataFrame:
    """(request_id, content_id, reward): engagement of the view an impression produced."""
    grouped = (
        events.filter("request_id IS NOT NULL AND content_id IS NOT NULL")
        .groupBy("request_id", "content_id")
        .agg(
            F.expr("max(greatest(dwell_seconds, 0D)) AS dwell"),
            F.expr("max_by(end_reason, IF(end_reason IS NOT NULL, struct(ts, event_id), NULL)) AS reason"),
            F.expr("greatest(count_if(event = 'CONTENT_VIEW_STARTED'), 1) AS visits"),
        )
    )
    estimate = eng.reading_time(f"{NOMINAL_WORDS}", "false", cfg)
    reward = eng.strength("dwell", estimate, "reason", "visits", "CAST(NULL AS DOUBLE)", cfg)
    return grouped.selectExpr("request_id", "content_id", f"{reward} AS reward")


def training_samples(served_items: DataFrame, rewards: DataFrame) -> DataFrame:
    """Served items with features, each with its reward (0 when it was never opened)."""
    return (
        served_items.filter("size(features) > 0")
        .join(rewards, ["request_id", "content_id"], "left")
        .withColumn("reward", F.expr("coalesce(reward, 0D)"))
    )


def sufficient_sums(samples: DataFrame, weight: str = "1D", by: tuple[str, ...] = ()) -> DataFrame:
    """A += w x x', b += w r x over all samples in one aggregate; only sums are shuffled."""
    upper = [(i, j) for i in range(D) for j in range(i, D)]
    sums = [F.expr(f"sum({weight} * features[{i}] * features[{j}]) AS a{i}_{j}") for i, j in upper]
    sums += [F.expr(f"sum({weight} * reward * features[{i}]) AS b{i}") for i in range(D)]
    sums.append(F.expr("count(*) AS n"))
    rows = samples.groupBy(*by).agg(*sums)
    cells = ", ".join(f"coalesce(a{min(i, j)}_{max(i, j)}, 0D)" for i in range(D) for j in range(D))
    return rows.selectExpr(
        *by, f"array({cells}) AS a", f"array({', '.join(f'coalesce(b{i}, 0D)' for i in range(D))}) AS b", "n AS n_updates"
    )


def prior_sql(cfg: RecConfig) -> tuple[str, str]:
    """A0 = ridge I and b0 = ridge w, so the untrained policy equals the fusion weights."""
    ridge = cfg.bandit_ridge
    a = ", ".join(f"{ridge if i == j else 0.0}D" for i in range(D) for j in range(D))
    b = ", ".join(f"{ridge * cfg.fusion.of(f)}D" for f in FEATURES)
    return f"array({a})", f"array({b})"


def prior_state(spark, cfg: RecConfig) -> DataFrame:
    a, b = prior_sql(cfg)
    return spark.range(1).selectExpr(f"{a} AS a", f"{b} AS b", "0L AS n_updates", f"{cfg.bandit_ridge}D AS ridge")


def train(samples: DataFrame, cfg: RecConfig, weight: str = "1D", start: DataFrame | None = None) -> DataFrame:
    """One-row state (a, b, n_updates, ridge): prior or given start plus all samples."""
    start = start if start is not None else prior_state(samples.sparkSession, cfg)
    parts = sufficient_sums(samples, weight).selectExpr("a", "b", "n_updates", "CAST(NULL AS DOUBLE) AS ridge").unionByName(
        start.select(*STATE_COLUMNS)
    )
    a = ", ".join(f"sum(a[{i}])" for i in range(D * D))
    b = ", ".join(f"sum(b[{i}])" for i in range(D))
    return parts.agg(
        F.expr(f"array({a}) AS a"), F.expr(f"array({b}) AS b"), F.expr("sum(n_updates) AS n_updates"), F.expr("max(ridge) AS ridge")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inverse(flat: pd.Series) -> pd.Series:
    return flat.map(lambda m: np.linalg.inv(np.asarray(m, dtype=np.float64).reshape(D, D)).ravel())


def policy(state: DataFrame) -> DataFrame:
    """State with a_inv and theta = A^-1 b (one 6 x 6 inverse)."""
    theta = ", ".join(
        "(" + " + ".join(f"a_inv[{i * D + j}] * b[{j}]" for j in range(D)) + ")" for i in range(D)
    )
    return state.withColumn("a_inv", _inverse("a")).withColumn("theta", F.expr(f"array({theta})"))


def policy_report(trained: DataFrame, cfg: RecConfig) -> DataFrame:
    """One row per feature: prior and learned weight, posterior std, data mass, confidence."""
    names = ", ".join(f"'{f}'" for f in FEATURES)
    prior = ", ".join(f"{cfg.fusion.of(f)}D" for f in FEATURES)
    rows = trained.selectExpr(
        "*", f"posexplode(array({names})) AS (i, feature)"
    ).selectExpr(
        "feature", "n_updates", f"get(array({prior}), i) AS prior", "get(theta, i) AS theta",
        f"sqrt(greatest(get(a_inv, i * {D} + i), 0D)) AS std", f"get(a, i * {D} + i) - ridge AS data",
        "1D / sqrt(ridge) AS prior_std",
    )
    return rows.selectExpr(
        "feature", "prior", "theta", "std", "data", "n_updates",
        "greatest(0D, least(1D, 1D - std / prior_std)) AS confidence", "data <= 1e-6D AS no_data",
    )


def policy_health(report: DataFrame) -> DataFrame:
    """Mean confidence over features with data, and the verdict."""
    one = report.agg(
        F.expr("max(n_updates) AS n_updates"),
        F.expr("coalesce(avg(IF(no_data, NULL, confidence)), 0D) AS mean_confidence"),
        F.expr("count_if(no_data) AS no_data_features"),
    )
    verdict = "CASE WHEN n_updates < 20 THEN 'cold' WHEN mean_confidence < 0.5 THEN 'learning' ELSE 'converged' END"
    return one.selectExpr("*", f"{verdict} AS verdict")


def split_sessions(samples: DataFrame, session: str, every: int) -> DataFrame:
    """Adds ``holdout``: every Nth session, in the order of a hash of its id."""
    sessions = samples.select(session).distinct()
    placed = global_position(sessions, F.expr(f"md5({session})"), session)
    return samples.join(placed.selectExpr(session, f"(position - 1) % {every} = 0 AS holdout"), session)


def auc(scored: DataFrame, name: str) -> DataFrame:
    """One row: chance that a positive outscores a negative, ties one half; NaN without both.

    Equal scores collapse first; negatives below each score are counted per score range
    and offset by the ranges below it, so no task sorts all scores. The ranges hold about as
    many scores each, however the scores lie, and are written before they are read twice.
    """
    by_score = scored.groupBy("score").agg(
        F.expr("count_if(label) AS pos"), F.expr("count_if(NOT label) AS neg")
    )
    ranged = materialize(by_score.repartitionByRange("score").withColumn("range", F.spark_partition_id()))
    below = ranged.groupBy("range").agg(F.expr("sum(neg) AS n")).selectExpr(
        "range", "coalesce(sum(n) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below"
    )
    inside = ranged.selectExpr(
        "range", "pos", "neg",
        "coalesce(sum(neg) OVER (PARTITION BY range ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS under",
    )
    return inside.join(below, "range").agg(
        F.expr(
            "coalesce(try_divide(sum(pos * (below + under + neg / 2D)), CAST(sum(pos) AS DOUBLE) * sum(neg)), CAST('NaN' AS DOUBLE))"
            f" AS {name}"
        )
    )


def linear_score(theta: str) -> str:
    return "(" + " + ".join(f"{theta}[{i}] * features[{i}]" for i in range(D)) + ")"


def evaluate(samples: DataFrame, cfg: RecConfig, session: str, every: int = 5) -> DataFrame:
    """Holdout AUC and correlation of the prior and of the policy trained on the rest."""
    # What a sample is judged by, and nothing else, goes through the shuffles and to the folder.
    split = materialize(split_sessions(samples.select(session, "features", "reward"), session, every).select("features", "reward", "holdout"))
    trained = policy(train(split.filter("NOT holdout"), cfg)).select("theta").scalar()
    prior = "array(" + ", ".join(f"{cfg.fusion.of(f)}D" for f in FEATURES) + ")"
    held = materialize(split.filter("holdout").withColumn("theta", trained).selectExpr(
        "reward", "reward > 0 AS label", f"{linear_score(prior)} AS prior_score", f"{linear_score('theta')} AS trained_score"
    ))
    summary = held.agg(
        F.expr("count(*) AS samples"), F.expr("count_if(label) AS engaged"),
        F.expr("corr(prior_score, reward) AS prior_corr"), F.expr("corr(trained_score, reward) AS trained_corr"),
    )
    a = auc(held.selectExpr("prior_score AS score", "label"), "auc").scalar()
    b = auc(held.selectExpr("trained_score AS score", "label"), "auc").scalar()
    verdict = (
        "CASE WHEN isnan(prior_auc) OR isnan(trained_auc) THEN 'inconclusive' "
        "WHEN trained_auc > prior_auc + 0.02D THEN 'use' ELSE 'keep prior' END"
    )
    return summary.withColumn("prior_auc", a).withColumn("trained_auc", b).selectExpr("*", f"{verdict} AS verdict")
