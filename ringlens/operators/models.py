"""Classifiers over feature tables ``(user_id, features..., label, split)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import boosting
from ringlens.operators.boosting import BoostedModel
from ringlens.operators.distribution import column_names, feature_name_audit, label_is_binary


def feature_names(variant: str) -> tuple[str, ...]:
    """Model inputs in order: graph features first, then behavioural ones."""
    return S.MODEL_FEATURES[variant]


def group_features(groups: Sequence[str]) -> tuple[str, ...]:
    """Behavioural features plus the named graph groups."""
    unknown = [g for g in groups if g not in S.FEATURE_GROUPS]
    if unknown:
        raise ValueError(f"unknown feature group: {unknown[0]}")
    return S.BASELINE_FEATURES + tuple(n for g in groups for n in S.FEATURE_GROUPS[g])


def select_features(table: DataFrame, names: Sequence[str]) -> DataFrame:
    keep = [c for c in ("split",) if c in table.columns]
    return table.select("user_id", *names, "label", *keep)


def audited(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """The selected features, refused when a column or label fails the audit."""
    selected = select_features(table, names)
    problems = feature_name_audit(column_names(selected.drop("split"))).unionByName(label_is_binary(selected))
    count = problems.count()
    if count:
        first = problems.select("subject", "check").orderBy("subject", "check").limit(10).collect()
        raise ValueError(f"feature audit failed with {count} findings, first: " + ", ".join(f"{r.subject} ({r.check})" for r in first))
    return selected


def class_weights(table: DataFrame) -> DataFrame:
    """One row: class counts, ``scale_pos_weight`` and the balanced weight of each class."""
    return table.agg(F.expr("count_if(label = 1)").alias("n_pos"), F.expr("count_if(label = 0)").alias("n_neg")).selectExpr(
        "n_pos", "n_neg", "n_neg / greatest(n_pos, 1) AS scale_pos_weight",
        "(n_pos + n_neg) / (2.0D * greatest(n_pos, 1)) AS balanced_pos", "(n_pos + n_neg) / (2.0D * greatest(n_neg, 1)) AS balanced_neg",
    )


def _weighted(table: DataFrame, positive: str, negative: str) -> DataFrame:
    weights = class_weights(table).select(F.struct(F.expr(positive).alias("p"), F.expr(negative).alias("n")))
    return table.withColumn("_w", weights.scalar()).withColumn("weight", F.expr("if(label = 1, _w.p, _w.n)")).drop("_w").withColumn(
        "label", F.col("label").cast("double")
    )


def train_logistic(train: DataFrame, names: Sequence[str], *, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """Standardised, L2-penalised logistic regression with balanced classes."""
    rows = _weighted(train, "balanced_pos", "balanced_neg")
    n = train.count()
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(names), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * max(n, 1)),
                           elasticNetParam=0.0, standardization=False),
    ]).fit(rows)


def train_boosted(
    train: DataFrame, names: Sequence[str], *, validation: DataFrame | None = None, **options
) -> BoostedModel:
    """One boosted model; ``validation`` turns on early stopping after 50 rounds without a better PR-AUC there."""
    if validation is not None:
        options.setdefault("patience", 50)
    return boosting.fit_models(train, {"model": names}, boosting.with_settings(**options), validation=validation)["model"]


def score(model: PipelineModel | BoostedModel, table: DataFrame) -> DataFrame:
    """``table`` with ``prob``, the probability of the positive class."""
    if isinstance(model, BoostedModel):
        return boosting.score(model, table)
    helpers = [c for c in ("raw_features", "features", "rawPrediction", "probability", "prediction") if c not in table.columns]
    rows = table.withColumn("label", F.col("label").cast("double")) if "label" in table.columns else table
    scored = model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop(*helpers)
    return scored.withColumn("label", F.col("label").cast("int")) if "label" in table.columns else scored


def save_model(spark: SparkSession, model: PipelineModel | BoostedModel, path: str) -> None:
    """A folder ``linear`` or ``boosted`` under ``path``."""
    if isinstance(model, BoostedModel):
        boosting.save(spark, model, f"{path}/boosted")
    else:
        model.write().overwrite().save(f"{path}/linear")


def load_model(spark: SparkSession, path: str, kind: str = "boosted") -> PipelineModel | BoostedModel:
    return boosting.load(spark, f"{path}/boosted") if kind == "boosted" else PipelineModel.load(f"{path}/linear")


# --- Importance --------------------------------------------------------------------------


def importance(spark: SparkSession, model: BoostedModel, *, method: str = "gain", top_k: int = 50) -> DataFrame:
    """``(feature, group, importance)``: mean gain, number of splits, or mean cover per feature."""
    measure = {"gain": F.avg("gain"), "weight": F.count(F.lit(1)).cast("double"), "cover": F.avg("cover")}
    if method not in measure:
        raise ValueError(f"unknown importance: {method}")
    group_of = {n: g for g, members in {**S.FEATURE_GROUPS, "baseline": S.BASELINE_FEATURES}.items() for n in members}
    labels = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(group_of.get(n, "unknown")).alias("group")) for n in model.names])
    return (
        boosting.nodes(spark, model).where("left >= 0").groupBy("feature").agg(measure[method].alias("importance"))
        .withColumn("l", labels[F.col("feature")]).select("l.feature", "l.group", "importance")
        .orderBy(F.desc("importance"), "feature").limit(top_k)
    )


def grouped_importance(importances: DataFrame) -> DataFrame:
    """``(group, features, importance, share)``: the importances of a model summed by feature group."""
    groups = importances.groupBy("group").agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("importance"))
    total = importances.agg(F.sum("importance")).scalar()
    return groups.withColumn("share", F.col("importance") / F.nullif(total, F.lit(0.0)))
