"""Cost, bootstrap, ring-level and error evaluation of scored users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens.functions.exprs import present
from ringlens.functions.ordered import exact_quantiles
from ringlens.operators import thresholds as TH
from ringlens.operators.bootstrap import bootstrap_metrics

# Cost of one wrong decision.
FALSE_POSITIVE_COST, FALSE_NEGATIVE_COST = 5000.0, 25000.0


def _with_cost(counts: DataFrame, fp_cost: float, fn_cost: float) -> DataFrame:
    return counts.withColumns({"fp_cost": F.col("fp") * F.lit(fp_cost), "fn_cost": F.col("fn") * F.lit(fn_cost)}).withColumn(
        "total_cost", F.col("fp_cost") + F.col("fn_cost")
    )


def cost(scored: DataFrame, threshold: float, fp_cost: float = FALSE_POSITIVE_COST, fn_cost: float = FALSE_NEGATIVE_COST) -> DataFrame:
    return _with_cost(TH.confusion(scored, threshold), fp_cost, fn_cost).select("model_id", "fp", "fn", "fp_cost", "fn_cost", "total_cost")


def cost_curve(
    scored: DataFrame, *, points: int = 100, fp_cost: float = FALSE_POSITIVE_COST, fn_cost: float = FALSE_NEGATIVE_COST
) -> DataFrame:
    """Metrics and cost at ``points`` equally spaced thresholds from 0 to 1.

    Every score falls into the last threshold it reaches, so users are counted once by that
    index and the few (model, index) counts are accumulated from the top.
    """
    last = points - 1
    # The rounded-down index may be off by one in floating point; compare with the grid itself.
    guess = f"cast(floor(prob * {last}) AS int)"
    indexed = TH.with_model(scored).withColumn("g", F.expr(f"greatest(0, least({last}, {guess}))")).selectExpr(
        "model_id", "label",
        f"CASE WHEN prob < g / {float(last)}D THEN g - 1 WHEN g < {last} AND prob >= (g + 1) / {float(last)}D THEN g + 1 ELSE g END AS i",
    )
    counts = indexed.groupBy("model_id", "i").agg(F.expr("count_if(label = 1) AS pos"), F.expr("count_if(label <> 1) AS neg"))
    totals = counts.groupBy("model_id").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(last))))
    above = Window.partitionBy("model_id").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        grid.join(counts, ["model_id", "i"], "left").na.fill(0, ["pos", "neg"])
        .withColumns({"tp": F.sum("pos").over(above), "fp": F.sum("neg").over(above)})
        .selectExpr("model_id", f"i / {float(last)}D AS threshold", "tp", "fp", "n_pos - tp AS fn", "n_neg - fp AS tn")
    )
    priced = _with_cost(TH.with_metrics(summed, "model_id", "threshold"), fp_cost, fn_cost)
    rounded = [F.round(c, 4).alias(c) for c in ("threshold", "precision", "recall", "f1")]
    return priced.select("model_id", *rounded, "fp", "fn", "fp_cost", "fn_cost", "total_cost")


def cost_optimal(curve: DataFrame) -> DataFrame:
    """The cheapest point of each model's cost curve; the lowest threshold wins ties."""
    rest = [c for c in curve.columns if c != "model_id"]
    best = F.min_by(F.struct(*rest), F.struct("total_cost", "threshold")).alias("point")
    return curve.groupBy("model_id").agg(best).select("model_id", "point.*")


# --- Bootstrap --------------------------------------------------------------------


def bootstrap_intervals(
    scored: DataFrame, threshold: float, *, replicates: int = 500, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """``(metric, lower, upper)``: percentile intervals over the replicates, 4 decimals."""
    names = ("precision", "recall", "f1", "pr_auc", "roc_auc")
    metrics = bootstrap_metrics(scored, threshold, replicates=replicates, seed=seed)
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    long = metrics.select(F.explode(items).alias("i")).select("i.metric", "i.value").where("value IS NOT NULL")
    tail = (1 - confidence) / 2
    bounds = exact_quantiles(long, ["metric"], "value", {"lower": tail, "upper": 1 - tail})
    return bounds.select("metric", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))


# --- Rings and scenarios ------------------------------------------------------------


def ring_detection(users: DataFrame, scored: DataFrame, threshold: float, *, min_fraction: float = 0.5) -> DataFrame:
    """Per ring: size, share of abuse members at or above the threshold, detected or not."""
    members = users.where(F.col("is_abuse_account") & present("ring_id")).select("user_id", "ring_id", "ring_type")
    rated = members.join(scored.select("user_id", "prob"), "user_id", "left").na.fill(0.0, ["prob"])
    grouped = rated.groupBy("ring_id").agg(
        F.min("ring_type").alias("ring_type"), F.count(F.lit(1)).alias("ring_size"),
        F.expr(f"count_if(prob >= {threshold}D)").alias("hits"), F.max("prob").alias("max_prob"), F.avg("prob").alias("mean_prob"),
    )
    return grouped.selectExpr(
        "ring_id", "ring_type", "ring_size", f"hits / ring_size >= {min_fraction}D AS detected",
        "round(hits / ring_size, 4) AS detection_rate", "round(max_prob, 4) AS max_member_prob", "round(mean_prob, 4) AS mean_member_prob",
    )


def ring_summary(rings: DataFrame) -> DataFrame:
    """Detected rings overall (ring_type 'all') and by type."""
    both = rings.select(F.explode(F.array(F.lit("all"), F.col("ring_type"))).alias("ring_type"), "detected")
    return both.groupBy("ring_type").agg(F.count(F.lit(1)).alias("total"), F.expr("count_if(detected)").alias("detected")).withColumn(
        "detection_rate", F.round(F.col("detected") / F.col("total"), 4)
    )


def scenario_recall(tagged: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    """Recall per ``scenario`` over labelled users; ``tagged`` is (user_id, scenario, is_abuse_account)."""
    rows = tagged.where(F.col("is_abuse_account") & present("scenario")).join(scored.select("user_id", "prob"), "user_id")
    return rows.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_users"), F.expr(f"count_if(prob >= {threshold}D)").alias("detected"),
        F.round(F.avg("prob"), 4).alias("mean_prob"),
    ).withColumn("recall", F.round(F.col("detected") / F.col("n_users"), 4))


def connected_legit_fpr(
    users: DataFrame, scored: DataFrame, threshold: float, *, min_size: int = 20, split: str = "test", group_prefix: str = "GRP_HIDDEN"
) -> DataFrame:
    """False positive rate over legitimate members of the large groups of hidden scenarios in one split."""
    legit = users.where((F.col("split") == split) & ~F.col("is_abuse_account") & F.col("group_id").startswith(group_prefix)).select("user_id", "group_id")
    large = legit.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("group_id")
    rows = legit.join(large, "group_id", "left_semi").join(scored.select("user_id", "prob"), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n_users"), F.expr(f"count_if(prob >= {threshold}D)").alias("false_positives")).withColumn(
        "fpr", F.expr("round(false_positives / nullif(n_users, 0), 4)")
    )


# --- Errors -----------------------------------------------------------------------


def _judged(users: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    context = users.select("user_id", "group_type", "group_id", "ring_id", "ring_type")
    return TH.apply_threshold(scored, threshold).join(context, "user_id")


def false_positives(users: DataFrame, scored: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """False positives with their groups, most confident first; ``n`` keeps the top of the list."""
    rows = _judged(users, scored, threshold).where("label = 0 AND prediction = 1").orderBy(F.desc("prob"), "user_id")
    return rows.limit(n) if n else rows


def false_negatives(users: DataFrame, scored: DataFrame, threshold: float, n: int | None = None) -> DataFrame:
    """Missed abuse accounts, lowest score first."""
    rows = _judged(users, scored, threshold).where("label = 1 AND prediction = 0").orderBy("prob", "user_id")
    return rows.limit(n) if n else rows


def _named(column: str, missing: str) -> Column:
    return F.when(present(column), F.col(column)).otherwise(F.lit(missing))


def false_positives_by_group(users: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    rows = _judged(users, scored, threshold).where("label = 0 AND prediction = 1")
    return rows.groupBy(_named("group_type", "individual").alias("group_type")).agg(F.count(F.lit(1)).alias("false_positives"))


def false_negatives_by_ring_type(users: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    rows = _judged(users, scored, threshold).where("label = 1 AND prediction = 0")
    return rows.groupBy(_named("ring_type", "unknown").alias("ring_type")).agg(F.count(F.lit(1)).alias("false_negatives"))


def fp_rate_by_group(users: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    rows = _judged(users, scored, threshold).where("label = 0")
    return rows.groupBy(_named("group_type", "individual").alias("group_type")).agg(F.avg(F.col("prediction").cast("double")).alias("fp_rate"))


def recall_by_ring_type(users: DataFrame, scored: DataFrame, threshold: float) -> DataFrame:
    rows = _judged(users, scored, threshold).where("label = 1")
    return rows.groupBy(_named("ring_type", "unknown").alias("ring_type")).agg(F.avg(F.col("prediction").cast("double")).alias("recall"))
