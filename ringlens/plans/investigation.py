"""Investigation records and risk assessments for all users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens.operators.boosting import BoostedModel
from ringlens.operators import attribution, evidence, explain, models, risk, typed_graph
from ringlens.operators.projection import UserGraph
from ringlens.session import cut_lineage


def investigate(
    features: DataFrame, train: DataFrame, transactions: DataFrame, graph: UserGraph, communities: DataFrame,
    model: BoostedModel, names: tuple[str, ...], *, top_k: int = 10,
) -> dict[str, DataFrame]:
    """The parts of every user's record, keyed by user: ``record`` plus the long lists.

    ``record`` nests what is bounded (factors, paths, counterfactuals, statements, community)
    and counts what is not; ``entities`` and ``related`` hold the full lists in parts.
    """
    edges = cut_lineage(typed_graph.user_entity_edges(transactions))
    scored = cut_lineage(models.score(model, features).select("user_id", "prob"))
    top = cut_lineage(explain.top_attributions(attribution.attributions(model, features, names), top_k))
    paths = cut_lineage(evidence.multi_hop_paths(edges))
    summary = explain.behavioural_summary(features)
    cf_names = [n for n in explain.S.COUNTERFACTUAL_FEATURES if n in names]
    changed = explain.counterfactuals(
        features, explain.training_statistics(train, cf_names), lambda rows: models.score(model, rows), cf_names)
    held = evidence.entities(edges)
    related = evidence.related_accounts(graph.edges)
    context = evidence.community_context(communities, graph.edges)

    counts = held.groupBy("user_id").agg(*[
        F.expr(f"count_if(node_type = '{kind}') AS {name}")
        for kind, name in zip(("device", "ip", "address", "payment_instrument"), risk.GRAPH_INPUTS)
    ])
    factors = top.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "feature", "value", "attribution", "direction", "description"))).alias("top_model_factors")
    )
    nested_paths = paths.groupBy("user_id").agg(F.array_sort(F.collect_list(
        F.struct("hop_count", "position", "nodes", "node_types", "edge_types", "path_strength"))).alias("multi_hop_paths"))
    record = scored.select("user_id", F.round("prob", 6).alias("risk_score"), risk.risk_level(F.col("prob")).alias("risk_level"))
    for part in (
        factors, nested_paths, summary, explain.ordered_counterfactuals(changed),
        context.select("user_id", F.struct("community_id", "community_size", "community_density", "user_degree", "neighbor_count").alias("community_context")),
        counts, related.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_related")),
    ):
        record = record.join(part, "user_id", "left")
    record = record.na.fill(0, ["n_devices", "n_ips", "n_addresses", "n_payments", "n_related"])
    return {
        "record": record, "entities": evidence.entity_lists(held),
        "related": evidence.related_lists(related), "counterfactuals": changed,
        "factors": top, "paths": paths, "edges": edges, "scores": scored, "held": held,
    }


def assess(record: DataFrame, *, model_version: str, policy: risk.Policy = risk.Policy()) -> DataFrame:
    """Decision, priority and reasons from an investigation record."""
    inputs = record.select(
        "user_id", *risk.GRAPH_INPUTS[:5], F.coalesce(F.size("multi_hop_paths"), F.lit(0)).alias("n_paths"),
        F.coalesce("community_context.community_density", F.lit(0.0)).alias("community_density"),
        *[F.col("feature_values")[c].alias(c) for c in risk.BEHAVIOUR_INPUTS],
        F.expr("get(top_model_factors, 0).direction AS top_direction"), F.expr("get(top_model_factors, 0).description AS top_description"),
    )
    # the level is that of the raw score; the rounded one may lie on the other side of a band's edge
    decided = risk.decide(record.select("user_id", F.col("risk_score").alias("prob"), "risk_level"), policy)
    return risk.assess(decided, inputs, model_version=model_version)
