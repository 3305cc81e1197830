"""Train every model of an experiment in one go, choose thresholds on validation data, test once, report.

The boosted models of the comparison and of the ablation grow side by side over one set of stored blocks; scores are
stored once and every report reads them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import boosting
from ringlens.operators import evaluation as E
from ringlens.operators import models as M
from ringlens.operators import thresholds as TH
from ringlens.operators.boosting import BoostedModel
from ringlens.session import cut_lineage

PATIENCE = 50
MAIN = ("A", "B", "C")


@dataclass(frozen=True)
class Trained:
    model_id: str
    model: PipelineModel | BoostedModel
    names: tuple[str, ...]


def _part(features: DataFrame, split: str) -> DataFrame:
    return features.where(F.col("split") == split)


def train_all(
    features: DataFrame, *, experiments: Mapping[str, Sequence[str]] = S.ABLATIONS, early_stopping: bool = True, **options
) -> dict[str, Trained]:
    """A: logistic on behaviour; B: boosted on behaviour; C: boosted on behaviour and graph; one boosted model for each of
    ``experiments`` (feature groups); B_stopped: B with early stopping on the validation split."""
    lists = {"B": M.feature_names("baseline"), "C": M.feature_names("graph")}
    lists |= {name: M.group_features(groups) for name, groups in experiments.items()}
    train = _part(features, "train")
    for names in set(lists.values()):
        M.audited(train, names)
    alike = {frozenset(names): names for names in reversed(lists.values())}  # the same features in another order are one model
    runs = {"|".join(sorted(names)): names for names in alike.values()}
    stopped = {"stopped": lists["B"]} if early_stopping else {}
    grown = boosting.fit_models(train, {**runs, **stopped}, boosting.with_settings(**options),
                                validation=_part(features, "val") if stopped else None, patience=dict.fromkeys(stopped, PATIENCE))
    models = {name: grown["|".join(sorted(names))] for name, names in lists.items()}
    models |= {"B_stopped": grown["stopped"]} if stopped else {}
    found = {"A": Trained("A", M.train_logistic(M.audited(train, lists["B"]), lists["B"]), lists["B"])}
    return found | {name: Trained(name, model, model.names) for name, model in models.items()}


def score_all(trained: Sequence[Trained], features: DataFrame) -> DataFrame:
    """``(model_id, split, user_id, label, prob)`` of every model."""
    parts = [
        M.score(t.model, features.select("user_id", "split", "label", *t.names)).select(
            F.lit(t.model_id).alias("model_id"), "split", "user_id", "label", "prob") for t in trained
    ]
    return reduce(DataFrame.unionByName, parts)


def chosen_thresholds(scores: DataFrame, strategy: str = "max_f1") -> DataFrame:
    """``(model_id, threshold)`` chosen on validation data alone: one row per model."""
    return TH.select_threshold(TH.threshold_curve(_part(scores, "val")), strategy).select("model_id", "threshold")


def compare(scores: DataFrame, *, strategy: str = "max_f1") -> DataFrame:
    """Per model: the threshold frozen on validation, and both splits' metrics at it; pass stored scores.

    The thresholds are one row per model and are broadcast.
    """
    judged = scores.where(F.col("split").isin("val", "test")).join(F.broadcast(chosen_thresholds(scores, strategy)), "model_id")
    counts = judged.groupBy("model_id", "split", "threshold").agg(
        F.expr("count_if(prob >= threshold AND label = 1) AS tp"), F.expr("count_if(prob >= threshold AND label = 0) AS fp"),
        F.expr("count_if(prob < threshold AND label = 1) AS fn"), F.expr("count_if(prob < threshold AND label = 0) AS tn"),
    )
    areas = [
        TH.roc_auc(_part(scores, s)).join(TH.average_precision(_part(scores, s)), "model_id").withColumn("split", F.lit(s)) for s in ("val", "test")
    ]
    return TH.with_metrics(counts, "model_id", "split", "threshold").join(areas[0].unionByName(areas[1]), ["model_id", "split"])


def ablation(scores: DataFrame, trained: Sequence[Trained]) -> DataFrame:
    """The comparison of models that differ in their features, with the number of these."""
    sizes = scores.sparkSession.createDataFrame([(t.model_id, len(t.names)) for t in trained], "model_id string, feature_count int")
    return compare(scores.where(F.col("model_id").isin([t.model_id for t in trained]))).join(F.broadcast(sizes), "model_id")


def reports(
    scores: DataFrame, users: DataFrame, *, scenario: str = "group_id", hidden_groups: str = "GRP_HIDDEN", strategy: str = "max_f1",
    replicates: int = 500, final: str = "C", largest_errors: int | None = None,
) -> dict[str, DataFrame]:
    """The tables of an experiment on its test split, at the thresholds frozen on validation data.

    ``metrics``; per model ``costs``, ``intervals``, ``rings``, ``ring_summary``, ``scenarios``, ``connected_legit``; for the
    ``final`` model the lists of errors and their breakdowns. ``scores`` are stored ones of the main models.
    """
    frozen = {r.model_id: r.threshold for r in chosen_thresholds(scores, strategy).collect()}  # one row per model
    test = _part(scores, "test")
    own_users = users.where(F.col("split") == "test")
    tagged = own_users.withColumn("scenario", F.col(scenario))
    tables: dict[str, list[DataFrame]] = {}
    for model_id, threshold in sorted(frozen.items()):
        own = test.where(F.col("model_id") == model_id).select("user_id", "label", "prob")
        rings = E.ring_detection(own_users, own, threshold)
        for name, table in (
            ("costs", E.cost(own, threshold).drop("model_id")), ("intervals", E.bootstrap_intervals(own, threshold, replicates=replicates)),
            ("rings", rings), ("ring_summary", E.ring_summary(rings)), ("scenarios", E.scenario_recall(tagged, own, threshold)),
            ("connected_legit", E.connected_legit_fpr(users, own, threshold, group_prefix=hidden_groups)),
        ):
            tables.setdefault(name, []).append(table.withColumn("model_id", F.lit(model_id)))
    found = {"metrics": compare(scores, strategy=strategy)} | {name: reduce(DataFrame.unionByName, parts) for name, parts in tables.items()}
    if final in frozen:
        own, threshold = test.where(F.col("model_id") == final).select("user_id", "label", "prob"), frozen[final]
        found |= {
            "false_positives": E.false_positives(own_users, own, threshold, largest_errors),
            "false_negatives": E.false_negatives(own_users, own, threshold, largest_errors),
            "false_positives_by_group": E.false_positives_by_group(own_users, own, threshold),
            "false_negatives_by_ring_type": E.false_negatives_by_ring_type(own_users, own, threshold),
            "fp_rate_by_group": E.fp_rate_by_group(own_users, own, threshold),
            "recall_by_ring_type": E.recall_by_ring_type(own_users, own, threshold),
        }
    return found


def run(features: DataFrame, users: DataFrame, **options) -> tuple[dict[str, Trained], DataFrame, dict[str, DataFrame]]:
    """Models, stored scores of all of them, and the reports of the main ones."""
    trained = train_all(features, **options)
    scores = cut_lineage(score_all(list(trained.values()), features))
    return trained, scores, reports(scores.where(F.col("model_id").isin(*MAIN)), users)
