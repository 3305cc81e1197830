from __future__ import annotations

from pyspark.sql import functions as F

from ringlens.operators import evaluation as E
from ringlens.operators import risk as R
from ringlens.operators import thresholds as TH
from ringlens.registry.base import REGISTRY, cte

add = REGISTRY.add
T = 0.55

cte("points", """
SELECT threshold, (SELECT count(*) FROM scored WHERE prob >= threshold AND label = 1) AS tp,
  (SELECT count(*) FROM scored WHERE prob >= threshold AND label = 0) AS fp,
  (SELECT count(*) FROM scored WHERE prob < threshold AND label = 1) AS fn,
  (SELECT count(*) FROM scored WHERE prob < threshold AND label = 0) AS tn
FROM (SELECT prob AS threshold FROM scored UNION SELECT 1.0::DOUBLE)""")
_METRICS = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS specificity"""
cte("curve", f"SELECT threshold, tp, fp, fn, tn, {_METRICS} FROM points")
_AT = f"""SELECT {T}::DOUBLE AS threshold, count(*) FILTER (prob >= {T} AND label = 1) AS tp, count(*) FILTER (prob >= {T} AND label = 0) AS fp,
  count(*) FILTER (prob < {T} AND label = 1) AS fn, count(*) FILTER (prob < {T} AND label = 0) AS tn FROM scored"""
cte("at_t", f"SELECT threshold, tp, fp, fn, tn, {_METRICS} FROM ({_AT})")
_SHOW = ("precision", "recall", "f1", "specificity")
_R = ", ".join(f"round({c}, 8) AS {c}" for c in _SHOW)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 8) for c in columns})


add("ev_01_at_threshold", lambda d: _rounded(TH.at_threshold(d.scored, T), *_SHOW).drop("model_id"), f"SELECT threshold, tp, fp, fn, tn, {_R} FROM at_t")
add("ev_02_threshold_curve", lambda d: _rounded(TH.threshold_curve(d.scored), *_SHOW).drop("model_id"), f"SELECT threshold, tp, fp, fn, tn, {_R} FROM curve")
_PICK = {
    "max_f1": "SELECT * FROM curve ORDER BY f1 DESC, threshold LIMIT 1",
    "high_recall": "SELECT * FROM curve WHERE recall >= 0.8 ORDER BY precision DESC, threshold LIMIT 1",
    "balanced": "SELECT * FROM curve ORDER BY abs(precision - recall), threshold LIMIT 1",
    "low_fp_rate": "SELECT * FROM curve WHERE recall >= 0.5 ORDER BY 1 - specificity, threshold LIMIT 1",
}
for _i, _s in enumerate(_PICK, start=3):
    add(f"ev_{_i:02d}_{_s}", lambda d, s=_s: _rounded(TH.select_threshold(TH.threshold_curve(d.scored), s), *_SHOW).drop("model_id"),
        f"SELECT '{_s}' AS strategy, threshold, tp, fp, fn, tn, {_R} FROM ({_PICK[_s]})")


def _two_models(d):
    return d.scored.withColumn("model_id", F.lit("first")).unionByName(
        d.scored.withColumns({"model_id": F.lit("second"), "prob": 1 - F.col("prob")}))


cte("scored_second", "SELECT user_id, label, 1 - prob AS prob FROM scored")
cte("points_second", """
SELECT threshold, (SELECT count(*) FROM scored_second WHERE prob >= threshold AND label = 1) AS tp,
  (SELECT count(*) FROM scored_second WHERE prob >= threshold AND label = 0) AS fp,
  (SELECT count(*) FROM scored_second WHERE prob < threshold AND label = 1) AS fn,
  (SELECT count(*) FROM scored_second WHERE prob < threshold AND label = 0) AS tn
FROM (SELECT prob AS threshold FROM scored_second UNION SELECT 1.0::DOUBLE)""")
cte("curve_second", f"SELECT threshold, tp, fp, fn, tn, {_METRICS} FROM points_second")
add("ev_07_all_strategies", lambda d: TH.all_strategies(TH.threshold_curve(_two_models(d))).select("model_id", "strategy", "threshold", "tp", "fp"),
    " UNION ALL ".join(f"SELECT '{m}' AS model_id, '{s}' AS strategy, threshold, tp, fp FROM ({q.replace('FROM curve', f'FROM {c}')})"
                       for m, c in (("first", "curve"), ("second", "curve_second")) for s, q in _PICK.items()))
add("ev_08_apply_threshold", lambda d: TH.apply_threshold(d.scored, T), f"SELECT *, (prob >= {T})::INT AS prediction FROM scored")
cte("roc", """SELECT sum(n * (SELECT count(*) FROM scored n WHERE n.label = 0 AND n.prob < p.prob) + 0.5 * n * (SELECT count(*) FROM scored n WHERE n.label = 0 AND n.prob = p.prob))
  / (sum(n) * (SELECT count(*) FROM scored WHERE label = 0)) AS roc_auc FROM (SELECT prob, count(*) AS n FROM scored WHERE label = 1 GROUP BY prob) p""")
cte("pr", """SELECT sum(n / (SELECT count(*) FROM scored WHERE label = 1) * (SELECT count(*) FROM scored x WHERE x.label = 1 AND x.prob >= p.prob)
  / (SELECT count(*) FROM scored x WHERE x.prob >= p.prob)) AS pr_auc FROM (SELECT prob, count(*) AS n FROM scored WHERE label = 1 GROUP BY prob) p""")
add("ev_09_roc_auc", lambda d: _rounded(TH.roc_auc(d.scored), "roc_auc").drop("model_id"), "SELECT round(roc_auc::DOUBLE, 8) AS roc_auc FROM roc")
add("ev_10_pr_auc", lambda d: _rounded(TH.average_precision(d.scored), "pr_auc").drop("model_id"), "SELECT round(pr_auc::DOUBLE, 8) AS pr_auc FROM pr")
add("ev_11_metric_bundle", lambda d: _rounded(TH.metric_bundle(d.scored, T), *_SHOW, "roc_auc", "pr_auc").drop("model_id"),
    f"""SELECT threshold, tp, fp, fn, tn, {_R}, round(roc_auc::DOUBLE, 8) AS roc_auc, round(pr_auc::DOUBLE, 8) AS pr_auc,
        tp + fp + fn + tn AS n_total, tp + fn AS n_pos, fp + tn AS n_neg FROM at_t, roc, pr""")
_COST = "fp * 5000.0::DOUBLE AS fp_cost, fn * 25000.0::DOUBLE AS fn_cost, fp * 5000.0::DOUBLE + fn * 25000.0::DOUBLE AS total_cost"
add("ev_12_cost", lambda d: E.cost(d.scored, T).drop("model_id"), f"SELECT fp, fn, {_COST} FROM at_t")
cte("cost_curve", f"""SELECT round(threshold, 4) AS threshold, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, fp, fn, {_COST} FROM (
  SELECT threshold, tp, fp, fn, tn, {_METRICS} FROM (SELECT i / 99.0::DOUBLE AS threshold, count(*) FILTER (prob >= i / 99.0::DOUBLE AND label = 1) AS tp,
    count(*) FILTER (prob >= i / 99.0::DOUBLE AND label = 0) AS fp, count(*) FILTER (prob < i / 99.0::DOUBLE AND label = 1) AS fn,
    count(*) FILTER (prob < i / 99.0::DOUBLE AND label = 0) AS tn FROM range(100) r(i), scored GROUP BY i))""")
add("ev_13_cost_curve", lambda d: E.cost_curve(d.scored).drop("model_id"), "SELECT * FROM cost_curve")
add("ev_14_cost_optimal", lambda d: E.cost_optimal(E.cost_curve(d.scored)).select("threshold", "total_cost"),
    "SELECT threshold, total_cost FROM cost_curve ORDER BY total_cost, threshold LIMIT 1")
add("ev_15_bootstrap_replicates", lambda d: E.bootstrap_metrics(d.scored, T, replicates=1000))
add("ev_16_bootstrap_intervals", lambda d: E.bootstrap_intervals(d.scored, T, replicates=500))
cte("rated_rings", f"""SELECT ring_id, min(ring_type) AS ring_type, count(*) AS ring_size, count(*) FILTER (prob >= {T}) / count(*) AS rate, max(prob) AS mx, avg(prob) AS mn
  FROM users JOIN scored USING (user_id) WHERE is_abuse_account AND ring_id <> '' GROUP BY ring_id""")
add("ev_17_ring_detection", lambda d: E.ring_detection(d.users, d.scored, T),
    """SELECT ring_id, ring_type, ring_size, rate >= 0.5 AS detected, round(rate, 4) AS detection_rate, round(mx, 4) AS max_member_prob, round(mn, 4) AS mean_member_prob FROM rated_rings""")
add("ev_18_ring_summary", lambda d: E.ring_summary(E.ring_detection(d.users, d.scored, T)),
    """SELECT unnest(['all', ring_type]) AS ring_type, count(*) AS total, count(*) FILTER (rate >= 0.5) AS detected,
       round(count(*) FILTER (rate >= 0.5) / count(*), 4) AS detection_rate FROM rated_rings GROUP BY 1""")
add("ev_19_scenario_recall", lambda d: E.scenario_recall(d.users.withColumn("scenario", F.col("city")), d.scored, T),
    f"""SELECT city AS scenario, count(*) AS n_users, count(*) FILTER (prob >= {T}) AS detected, round(avg(prob), 4) AS mean_prob,
        round(count(*) FILTER (prob >= {T}) / count(*), 4) AS recall FROM users JOIN scored USING (user_id) WHERE is_abuse_account GROUP BY city""")
# the star data has no hidden scenarios: all its groups stand for them
for _name, _size in (("ev_20_connected_legit_fpr", 20), ("ev_20_smaller_groups", 8)):
    add(_name, lambda d, n=_size: E.connected_legit_fpr(d.users, d.scored, T, min_size=n, group_prefix="GRP_"),
        f"""SELECT count(*) AS n_users, count(*) FILTER (prob >= {T}) AS false_positives, round(count(*) FILTER (prob >= {T}) / nullif(count(*), 0), 4) AS fpr FROM (
            SELECT user_id, count(*) OVER (PARTITION BY group_id) AS n FROM users WHERE split = 'test' AND NOT is_abuse_account AND group_id LIKE 'GRP\\_%' ESCAPE '\\')
            JOIN scored USING (user_id) WHERE n >= {_size}""")
_CONTEXT = "user_id, label, prob, (prob >= {t})::INT AS prediction, group_type, group_id, ring_id, ring_type".format(t=T)
add("ev_21_false_positives", lambda d: E.false_positives(d.users, d.scored, T, 20),
    f"SELECT {_CONTEXT} FROM users JOIN scored USING (user_id) WHERE label = 0 AND prob >= {T} ORDER BY prob DESC, user_id LIMIT 20")
add("ev_21_false_negatives", lambda d: E.false_negatives(d.users, d.scored, T, 20),
    f"SELECT {_CONTEXT} FROM users JOIN scored USING (user_id) WHERE label = 1 AND prob < {T} ORDER BY prob, user_id LIMIT 20")
_BY = "SELECT CASE WHEN {c} <> '' THEN {c} ELSE '{m}' END AS {c}, {agg} FROM users JOIN scored USING (user_id) WHERE {w} GROUP BY 1"
add("ev_22_false_positives_by_group", lambda d: E.false_positives_by_group(d.users, d.scored, T),
    _BY.format(c="group_type", m="individual", agg="count(*) AS false_positives", w=f"label = 0 AND prob >= {T}"))
add("ev_23_false_negatives_by_ring_type", lambda d: E.false_negatives_by_ring_type(d.users, d.scored, T),
    _BY.format(c="ring_type", m="unknown", agg="count(*) AS false_negatives", w=f"label = 1 AND prob < {T}"))
add("ev_24_fp_rate_by_group", lambda d: _rounded(E.fp_rate_by_group(d.users, d.scored, T), "fp_rate"),
    _BY.format(c="group_type", m="individual", agg=f"round(avg((prob >= {T})::INT), 8) AS fp_rate", w="label = 0"))
add("ev_25_recall_by_ring_type", lambda d: _rounded(E.recall_by_ring_type(d.users, d.scored, T), "recall"),
    _BY.format(c="ring_type", m="unknown", agg=f"round(avg((prob >= {T})::INT), 8) AS recall", w="label = 1"))

# --- Risk -----------------------------------------------------------------------------

cte("decided", """SELECT user_id, prob AS risk_score,
  CASE WHEN prob >= 0.8 THEN 'critical' WHEN prob >= 0.5 THEN 'high' WHEN prob >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN prob >= 0.8 THEN 'escalate' WHEN prob >= 0.5 THEN 'review' WHEN prob >= 0.2 THEN 'monitor' ELSE 'allow' END AS decision,
  CASE WHEN prob >= 0.8 THEN 'urgent' WHEN prob >= 0.5 THEN 'high' WHEN prob >= 0.2 THEN 'normal' END AS review_priority FROM scored""")
add("rsk_01_risk_level", lambda d: R.decide(d.scored).select("user_id", "risk_level"), "SELECT user_id, risk_level FROM decided")
add("rsk_02_policy", lambda d: R.decide(d.scored), "SELECT * FROM decided")
add("rsk_02_custom_policy", lambda d: R.decide(d.scored, R.Policy(0.3, 0.6, 0.9)).select("user_id", "decision"),
    """SELECT user_id, CASE WHEN prob >= 0.9 THEN 'escalate' WHEN prob >= 0.6 THEN 'review' WHEN prob >= 0.3 THEN 'monitor' ELSE 'allow' END AS decision FROM scored""")
add("rsk_05_score_users", lambda d: R.score_users(R.decide(d.scored), d.transactions.where("transaction_status = 'failed'").select("user_id")),
    "SELECT * FROM decided WHERE user_id IN (SELECT user_id FROM txns WHERE transaction_status = 'failed')")
_QUEUE = "SELECT * FROM decided WHERE decision IN ('review', 'escalate') ORDER BY (decision = 'escalate') DESC, risk_score DESC, user_id"
add("rsk_06_review_queue", lambda d: R.review_queue(R.decide(d.scored)), _QUEUE)
add("rsk_07_top_of_queue", lambda d: R.top_of_queue(R.decide(d.scored), 25), _QUEUE + " LIMIT 25")
add("rsk_07_queue_size", lambda d: R.queue_size(R.decide(d.scored)), "SELECT count(*) FILTER (decision IN ('review', 'escalate')) AS queue_size FROM decided")
add("rsk_08_risk_distribution", lambda d: R.risk_distribution(R.decide(d.scored)),
    "SELECT 'level' AS kind, risk_level AS value, count(*) AS users FROM decided GROUP BY 2 UNION ALL SELECT 'decision', decision, count(*) FROM decided GROUP BY 2")
_STATS = ("min", "max", "mean", "median", "p95", "p99")
add("rsk_08_score_statistics", lambda d: _rounded(R.score_statistics(R.decide(d.scored)), *_STATS),
    """SELECT round(min(prob), 8) AS min, round(max(prob), 8) AS max, round(avg(prob), 8) AS mean, round(median(prob), 8) AS median,
       round(quantile_cont(prob, 0.95), 8) AS p95, round(quantile_cont(prob, 0.99), 8) AS p99 FROM scored""")
add("rsk_09_examples", lambda d: R.examples(R.decide(d.scored)),
    """(SELECT *, 'high' AS band FROM decided WHERE risk_score >= 0.5 ORDER BY user_id LIMIT 5) UNION ALL
       (SELECT *, 'medium' FROM decided WHERE risk_score >= 0.2 AND risk_score < 0.5 ORDER BY user_id LIMIT 3) UNION ALL
       (SELECT *, 'low' FROM decided WHERE risk_score < 0.2 ORDER BY user_id LIMIT 2)""")
