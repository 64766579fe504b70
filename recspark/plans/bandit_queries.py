"""Queries of the served log and the bandit."""

from __future__ import annotations

from recspark.config import FEATURES
from recspark.operators import bandit as bd
from recspark.operators.scoring import apply_policy
from recspark.plans import bindings as b
from recspark.plans.oracle import cte
from recspark.plans.registry import query, r6
from recspark.plans.signal_queries import CFG

cte("served_lines", """
SELECT * FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS request_id, CAST(l_partkey AS VARCHAR) AS content_id, l_linenumber AS rank, l_quantity, l_returnflag, l_linestatus,
       [l_quantity / 50, l_discount * 10, l_tax * 12.5, l_linenumber / CAST(7 AS DOUBLE), l_extendedprice / 105000, (l_suppkey % 10) / CAST(10 AS DOUBLE)] AS x,
       row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1
""")
cte("line_rewards", """
SELECT *, CASE WHEN l_linestatus = 'F' THEN
   0.4 * least(l_quantity * 2 / (150 / CAST(4.2 AS DOUBLE)), 2.0) / 2.0 + 0.3 * (CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.6 ELSE -0.5 END)
   + 0.2 * (1 - exp(CAST(-0.5 AS DOUBLE))) ELSE 0 END AS reward FROM served_lines
""")
cte("train_split", """
SELECT s.*, o.user_id, (pos - 1) % 5 = 0 AS holdout FROM line_rewards s JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CAST(o_custkey AS VARCHAR) AS user_id FROM orders) o USING (request_id)
JOIN (SELECT user_id, row_number() OVER (ORDER BY md5(user_id), user_id) AS pos FROM (
   SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS user_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))) p USING (user_id)
""")
_PRIOR = "[0.20, 0.10, 0.45, 0.05, -0.30, 0.20]"


def _gauss(name: str, source: str) -> None:
    """Gauss-Jordan elimination of [A | b | I] in DuckDB lists, without pivoting (A is SPD)."""
    rows = ", ".join(
        "[" + ", ".join(
            f"sum(x[{i + 1}] * x[{j + 1}])" + (" + 1.0" if i == j else "") for j in range(6)
        ) + f", sum(reward * x[{i + 1}]) + CAST({_PRIOR}[{i + 1}] AS DOUBLE)"
        + "".join(f", {1.0 if i == j else 0.0}" for j in range(6)) + "]"
        for i in range(6)
    )
    cte(f"{name}_walk", f"""
SELECT 0 AS i, CAST([{rows}] AS DOUBLE[][]) AS m FROM {source}
UNION ALL
SELECT i + 1, list_transform(m, lambda row, r: CASE WHEN r = i + 1 THEN list_transform(row, lambda x: x / m[i + 1][i + 1])
   ELSE list_transform(row, lambda x, c: x - row[i + 1] * m[i + 1][c] / m[i + 1][i + 1]) END) FROM {name}_walk WHERE i < 6
""")
    cte(name, f"SELECT list_transform(m, lambda row: row[7]) AS theta, list_transform(m, lambda row: row[8:13]) AS inv FROM {name}_walk WHERE i = 6")


_gauss("solved_all", "line_rewards")
_gauss("solved_train", "(SELECT * FROM train_split WHERE NOT holdout)")
cte("held_scores", f"""
SELECT reward, reward > 0 AS label, list_dot_product(CAST({_PRIOR} AS DOUBLE[]), x) AS p, list_dot_product((SELECT theta FROM solved_train), x) AS t FROM train_split WHERE holdout
""")


def _samples(spark, sf_dir):
    rewards = bd.impression_rewards(b.reward_events(spark, sf_dir), CFG)
    return bd.training_samples(b.served_items(spark, sf_dir), rewards)


@query("impression_rewards", "SELECT request_id, content_id, round(reward, 6) AS reward FROM line_rewards WHERE l_linestatus = 'F'")
def impression_rewards(spark, sf_dir):
    rewards = bd.impression_rewards(b.reward_events(spark, sf_dir), CFG)
    return rewards.selectExpr("request_id", "content_id", *r6("reward"))


@query("training_samples", "SELECT request_id, content_id, CAST(rank AS INTEGER) AS rank, round(list_sum(x), 6) AS feature_sum, round(reward, 6) AS reward FROM line_rewards")
def training_samples(spark, sf_dir):
    return _samples(spark, sf_dir).selectExpr(
        "request_id", "content_id", "rank", "round(aggregate(features, 0D, (a, x) -> a + x), 6) AS feature_sum", *r6("reward"))


@query("bandit_sums", """
SELECT i, j, round(sum(x[i] * x[j]), 4) AS a, round(sum(reward * x[i]), 4) AS b, count(*) AS n
FROM line_rewards, range(1, 7) r1(i), range(1, 7) r2(j) GROUP BY i, j
""")
def bandit_sums(spark, sf_dir):
    sums = bd.sufficient_sums(_samples(spark, sf_dir))
    cells = sums.selectExpr("posexplode(a) AS (at, a)", "b", "n_updates AS n")
    return cells.selectExpr("CAST(at div 6 + 1 AS BIGINT) AS i", "CAST(at % 6 + 1 AS BIGINT) AS j", "round(a, 4) AS a", "round(get(b, CAST(at div 6 AS INT)), 4) AS b", "n")


@query("policy_report", """
SELECT unnest(['semantic','affinity','tag','recency','aversion','geo']) AS feature, unnest(CAST([0.20, 0.10, 0.45, 0.05, -0.30, 0.20] AS DOUBLE[])) AS prior,
  round(unnest(theta), 6) AS theta, round(sqrt(unnest([inv[1][1], inv[2][2], inv[3][3], inv[4][4], inv[5][5], inv[6][6]])), 6) AS std,
  round(1 - sqrt(unnest([inv[1][1], inv[2][2], inv[3][3], inv[4][4], inv[5][5], inv[6][6]])), 6) AS confidence,
  (SELECT count(*) FROM line_rewards) AS n_updates FROM solved_all
""")
def policy_report(spark, sf_dir):
    trained = bd.policy(bd.train(_samples(spark, sf_dir), CFG))
    return bd.policy_report(trained, CFG).selectExpr("feature", "prior", "n_updates", *r6("theta", "std", "confidence"))


@query("policy_health", """
SELECT (SELECT count(*) FROM line_rewards) AS n_updates, round(1 - (sqrt(inv[1][1]) + sqrt(inv[2][2]) + sqrt(inv[3][3]) + sqrt(inv[4][4]) + sqrt(inv[5][5]) + sqrt(inv[6][6])) / 6, 6) AS mean_confidence,
  0 AS no_data_features, 'converged' AS verdict FROM solved_all
""")
def policy_health(spark, sf_dir):
    trained = bd.policy(bd.train(_samples(spark, sf_dir), CFG))
    return bd.policy_health(bd.policy_report(trained, CFG)).selectExpr(
        "n_updates", "no_data_features", "verdict", *r6("mean_confidence"))


@query("policy_scores", """
SELECT request_id, content_id, round(list_dot_product(theta, x) + 0.3 * sqrt(list_dot_product(x, list_transform(inv, lambda row: list_dot_product(row, x)))), 6) AS score
FROM line_rewards, solved_all
""")
def policy_scores(spark, sf_dir):
    samples = _samples(spark, sf_dir)
    trained = bd.policy(bd.train(samples, CFG))
    rows = samples.selectExpr("request_id", "content_id", "features", "0D AS final_score")
    return apply_policy(rows, trained, CFG).selectExpr("request_id", "content_id", "round(final_score, 6) AS score")


@query("bandit_evaluation", """
SELECT (SELECT count(*) FROM held_scores) AS samples, (SELECT count(*) FROM held_scores WHERE label) AS engaged,
  round(pa, 6) AS prior_auc, round(ta, 6) AS trained_auc, round(pc, 6) AS prior_corr, round(tc, 6) AS trained_corr,
  CASE WHEN ta > pa + 0.02 THEN 'use' ELSE 'keep prior' END AS verdict
FROM (SELECT corr(p, reward) AS pc, corr(t, reward) AS tc FROM held_scores),
 (SELECT (sum(CASE WHEN label THEN r END) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * CAST(count(*) FILTER (NOT label) AS DOUBLE)) AS pa
  FROM (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM held_scores)),
 (SELECT (sum(CASE WHEN label THEN r END) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * CAST(count(*) FILTER (NOT label) AS DOUBLE)) AS ta
  FROM (SELECT label, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS r FROM held_scores))
""")
def bandit_evaluation(spark, sf_dir):
    users = b.served(spark, sf_dir).select("request_id", "user_id")
    samples = _samples(spark, sf_dir).join(users, "request_id")
    return bd.evaluate(samples, CFG, "user_id").selectExpr(
        "samples", "engaged", "verdict", *r6("prior_auc", "trained_auc", "prior_corr", "trained_corr"))


assert len(FEATURES) == 6
