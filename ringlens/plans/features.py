"""Split-isolated feature tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import behaviour, centrality, communities, graph_features, projection

def user_graph_features(
    transactions: DataFrame, graph: projection.UserGraph, *, betweenness_sources: DataFrame | None = None
) -> DataFrame:
    """``(view, user_id)`` and the 24 graph features without communities, for users with transactions.

    ``transactions`` carries ``view``; pass a stored graph, because it is read many times.
    """
    arcs = projection.both_directions(graph.edges)
    totals = graph_features.node_totals(arcs)
    direct = graph_features.direct_features(transactions)
    table = direct.join(graph_features.projection_features(graph), ["view", "user_id"], "left")
    for part in (graph_features.degree_and_clustering(graph, totals), centrality.betweenness(graph, betweenness_sources).drop("betweenness_approx")):
        table = table.join(part, ["view", "user_id"], "left")
    names = [n for n in S.GRAPH_FEATURES if n not in S.FEATURE_GROUPS["community"]]
    return table.select("view", "user_id", *names).na.fill(0)


def build_split_features(tables: Mapping[str, DataFrame], *, betweenness_pivots: int | None = None) -> DataFrame:
    """``(user_id, 27 graph, 23 behavioural features, label, split)`` for every user.

    All splits are built by one plan: the split travels as the ``view`` key, no edge crosses it.
    Betweenness is exact unless the caller asks for a number of pivots per split.
    """
    users, transactions = tables["users"], tables["transactions"]
    tagged = projection.split_views(transactions, users)
    members = users.select(F.col("split").alias("view"), "user_id")
    graph = projection.project_users(tagged, members).stored()
    labels = communities.louvain(graph)
    sources = None if betweenness_pivots is None else centrality.pivots(graph.nodes, betweenness_pivots)
    return (
        users.select("user_id", "split", F.col("is_abuse_account").cast("int").alias("label"))
        .join(behaviour.behavioural_features(users, transactions, tables["devices"]), "user_id", "left")
        .join(user_graph_features(tagged, graph, betweenness_sources=sources).drop("view"), "user_id", "left")
        .join(communities.community_features(labels, graph).drop("view", "community_id"), "user_id", "left")
        .select("user_id", *S.GRAPH_FEATURES, *S.BASELINE_FEATURES, "label", "split")
        .na.fill(0)
    )
