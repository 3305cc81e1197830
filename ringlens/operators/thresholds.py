"""Threshold curves and selection for scored users ``(model_id, user_id, label, prob)``.

Scores are grouped by value before anything is accumulated, and the accumulation itself is
distributed, so a model with many distinct scores never sorts in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.functions.ordered import running_totals

STRATEGIES = ("max_f1", "high_recall", "balanced", "low_fp_rate")

_METRICS = (
    "if(tp + fp > 0, tp / (tp + fp), 0D) AS precision",
    "if(tp + fn > 0, tp / (tp + fn), 0D) AS recall",
    "if(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn), 0D) AS f1",
    "if(tn + fp > 0, tn / (tn + fp), 0D) AS specificity",
)


def with_model(scored: DataFrame, model_id: str = "model") -> DataFrame:
    return scored if "model_id" in scored.columns else scored.withColumn("model_id", F.lit(model_id))


def with_metrics(counts: DataFrame, *keep: str) -> DataFrame:
    """Precision, recall, F1 and specificity from tp, fp, fn, tn."""
    return counts.selectExpr(*keep, "tp", "fp", "fn", "tn", *_METRICS)


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    """Confusion counts per model at one threshold (a score equal to it is positive)."""
    hit, actual = f"prob >= {threshold}D", "label = 1"
    return with_model(scored).groupBy("model_id").agg(
        F.expr(f"count_if({hit} AND {actual}) AS tp"), F.expr(f"count_if({hit} AND NOT {actual}) AS fp"),
        F.expr(f"count_if(NOT {hit} AND {actual}) AS fn"), F.expr(f"count_if(NOT {hit} AND NOT {actual}) AS tn"),
    )


def at_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return with_metrics(confusion(scored, threshold), "model_id", f"{threshold}D AS threshold")


def apply_threshold(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.withColumn("prediction", (F.col("prob") >= F.lit(threshold)).cast("int"))


def _cumulated(scored: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives at or above it, and the model's totals."""
    by_score = with_model(scored).groupBy("model_id", "prob").agg(
        F.expr("count_if(label = 1) AS pos"), F.expr("count_if(label <> 1) AS neg")
    )
    totals = by_score.groupBy("model_id").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return running_totals(by_score, ["model_id"], "prob", ["pos", "neg"], descending=True).join(F.broadcast(totals), "model_id")


def threshold_curve(scored: DataFrame) -> DataFrame:
    """Metrics at every candidate threshold: each distinct score, and 1.0."""
    cumulated = _cumulated(scored).selectExpr("model_id", "prob AS threshold", "cum_pos AS tp", "cum_neg AS fp", "n_pos", "n_neg")
    top = (
        with_model(scored).groupBy("model_id").agg(
            F.expr("count_if(label = 1) AS n_pos"), F.expr("count_if(label <> 1) AS n_neg"), F.max("prob").alias("highest")
        )
        .where("highest < 1")
        .selectExpr("model_id", "1D AS threshold", "0L AS tp", "0L AS fp", "n_pos", "n_neg")
    )
    points = cumulated.unionByName(top).selectExpr("model_id", "threshold", "tp", "fp", "n_pos - tp AS fn", "n_neg - fp AS tn")
    return with_metrics(points, "model_id", "threshold")


def _score(strategy: str, min_recall: float | None) -> tuple[str, str]:
    """(score, eligibility) of a strategy; the highest score among eligible points wins."""
    if strategy == "max_f1":
        return "f1", "true"
    if strategy == "balanced":
        return "-abs(precision - recall)", "true"
    if strategy == "high_recall":
        return "precision", f"recall >= {0.80 if min_recall is None else min_recall}D"
    if strategy == "low_fp_rate":
        return "-(1 - specificity)", f"recall >= {0.50 if min_recall is None else min_recall}D"
    raise ValueError(f"unknown strategy: {strategy}")


def _picks(curve: DataFrame, strategies: Sequence[str], min_recall: float | None = None) -> DataFrame:
    """All strategies' points in one pass over the curve: the lowest threshold wins ties, and the best F1 stands in
    where no point is eligible."""
    point = F.struct(*[c for c in curve.columns if c != "model_id"])

    def best(score: str, eligible: str):
        return F.min_by(point, F.when(F.expr(eligible), F.struct(-F.expr(score), F.col("threshold"))))

    rows = curve.groupBy("model_id").agg(*[F.coalesce(best(*_score(s, min_recall)), best("f1", "true")).alias(s) for s in strategies])
    named = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("point")) for s in strategies])
    return rows.select("model_id", F.explode(named).alias("pick")).select("model_id", "pick.strategy", "pick.point.*")


def select_threshold(
    curve: DataFrame, strategy: str, *, min_recall: float | None = None
) -> DataFrame:
    """One row per model: the threshold the strategy picks on ``curve`` with its metrics."""
    return _picks(curve, [strategy], min_recall)


def all_strategies(curve: DataFrame) -> DataFrame:
    return _picks(curve, STRATEGIES)


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve; a tie between a positive and a negative counts one half. Null for one class."""
    return _cumulated(scored).groupBy("model_id").agg(
        (F.sum(F.expr("pos * (n_neg - cum_neg + neg / 2.0D)")) / F.first(F.expr("nullif(n_pos * cast(n_neg AS double), 0)"))).alias("roc_auc")
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """Step-wise sum of precision over recall increments."""
    return _cumulated(scored).groupBy("model_id").agg(
        F.sum(F.expr("pos / nullif(cast(n_pos AS double), 0) * cum_pos / (cum_pos + cum_neg)")).alias("pr_auc")
    )


def metric_bundle(scored: DataFrame, threshold: float) -> DataFrame:
    return (
        at_threshold(scored, threshold)
        .join(roc_auc(scored), "model_id").join(average_precision(scored), "model_id")
        .withColumns({"n_total": F.expr("tp + fp + fn + tn"), "n_pos": F.expr("tp + fn"), "n_neg": F.expr("fp + tn")})
    )
