"""Checks of the graph and of the features built from it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import typed_graph as G
from ringlens.operators.data_checks import combine, finding
from ringlens.operators.projection import UserGraph, crossing_edges


def node_existence(nodes: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Nodes of an unknown type, and nodes absent from the table of their type."""
    sources = combine([
        tables[table].select(F.lit(kind).alias("node_type"), F.col(key).cast("string").alias("id"))
        for kind, (table, key) in S.NODE_SOURCES.items()
    ])
    valid = F.coalesce(F.col("node_type").isin(*S.NODE_SOURCES), F.lit(False))
    odd = nodes.where(~valid).agg(F.count(F.lit(1)).alias("n"))
    missing = nodes.where(valid).join(sources, ["node_type", "id"], "left_anti").groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
    return combine([
        finding(odd, "graph_integrity", "node_type_metadata", "error", "nodes", "invalid node types"),
        finding(missing, "graph_integrity", "node_existence", "error", F.col("node_type"), "nodes absent from the source table"),
    ])


def self_loops(edges: DataFrame) -> DataFrame:
    loops = edges.where("src = dst").agg(F.count(F.lit(1)).alias("n"))
    return finding(loops, "graph_integrity", "self_loops", "error", "edges", "self-loops")


def edge_provenance(edges: DataFrame, transactions: DataFrame) -> DataFrame:
    """User-entity edges without a transaction row, unknown edge types, and how many were verified."""
    observed = G.user_entity_edges(transactions).drop("weight")
    entity = edges.where(F.col("edge_type").isin(*S.ENTITY_EDGE_TYPES))
    unbacked = entity.join(observed, ["src", "dst", "edge_type"], "left_anti").groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))
    unknown = edges.where(~F.coalesce(F.col("edge_type").isin(*S.EDGE_TYPES), F.lit(False)))
    return combine([
        finding(unbacked, "graph_integrity", "edge_provenance", "error", F.col("edge_type"), "edges not backed by a transaction"),
        finding(unknown.agg(F.count(F.lit(1)).alias("n")), "graph_integrity", "edge_type_metadata", "error", "edges", "invalid edge types"),
        finding(entity.agg(F.count(F.lit(1)).alias("n")), "graph_integrity", "edge_provenance", "info", "edges", "user-entity edges verified"),
    ])


def edge_digests(edges: DataFrame) -> DataFrame:
    """``(edge_type, rows, digest)``: equal for two tables that hold the same rows equally often, in any order.

    A digest is the XOR of one 64-bit row hash and the sums of both halves of another: one aggregate, combined before its shuffle.
    """
    first, second = (F.xxhash64(F.lit(seed), *[F.struct(c) for c in G.EDGE_COLUMNS]) for seed in (1, 2))
    low, high = second.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(second, 32)
    return edges.groupBy("edge_type").agg(
        F.count(F.lit(1)).alias("rows"), F.struct(F.bit_xor(first).alias("x"), F.sum(low).alias("low"), F.sum(high).alias("high")).alias("digest"))


def differing_types(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(edge_type)`` of the kinds of edges in which two graphs differ."""
    a, b = edge_digests(left), edge_digests(right)
    return a.selectExpr("edge_type", "rows", "digest").join(b.selectExpr("edge_type AS t", "rows AS r", "digest AS g"), F.col("edge_type") == F.col("t"), "full").where(
        "NOT (rows <=> r AND digest <=> g)").select(F.coalesce("edge_type", "t").alias("edge_type"))


def changed_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(src, dst, edge_type, weight, surplus)``: rows that one graph holds more often (above 0: the left one).

    Only kinds of edges with differing digests are compared row by row: at most one row per kind, which is broadcast.
    """
    kinds = F.broadcast(differing_types(left, right))
    sides = left.select(*G.EDGE_COLUMNS, F.lit(1).alias("side")).unionByName(right.select(*G.EDGE_COLUMNS, F.lit(-1).alias("side")))
    return sides.join(kinds, "edge_type", "left_semi").groupBy(*G.EDGE_COLUMNS).agg(F.sum("side").alias("surplus")).where("surplus <> 0")


def label_independence(tables: Mapping[str, DataFrame], build: Callable[[DataFrame], DataFrame] = G.build_edges) -> DataFrame:
    """Edges that appear or vanish when the label columns are removed before building."""
    transactions = tables["transactions"]
    changed = changed_edges(build(transactions), build(transactions.drop(*S.LABEL_FIELDS)))
    counted = changed.agg(F.coalesce(F.sum(F.abs("surplus")), F.lit(0)).alias("n"))
    return finding(counted, "graph_label_independence", "label_independence", "error", "edges", "edges depending on labels")


def split_isolation(edges: DataFrame | UserGraph, nodes: DataFrame, users: DataFrame) -> DataFrame:
    """``edges(view, a, b)`` and ``nodes(view, user_id)`` must stay inside the split named by view.

    ``edges`` may be the user graph: if it has links, the edges are counted from them, and not spelled out.
    """
    split = users.select("user_id", "split")
    foreign = nodes.join(split, "user_id", "left").where("split IS NULL OR split <> view").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(edges, UserGraph) and edges.links is not None:
        crossing = crossing_edges(edges.links, split.withColumnRenamed("split", "tag"))
    else:
        crossing = (
            (edges.edges if isinstance(edges, UserGraph) else edges).select("view", "a", "b")
            .join(split.selectExpr("user_id AS a", "split AS sa"), "a", "left")
            .join(split.selectExpr("user_id AS b", "split AS sb"), "b", "left")
            .where("NOT (sa <=> sb)")
            .groupBy("view").agg(F.count(F.lit(1)).alias("n"))
        )
    return combine([
        finding(foreign, "split_isolation", "node_membership", "error", "nodes", "users of another split"),
        finding(crossing, "split_isolation", "cross_split_edge", "error", F.col("view"), "edges between splits"),
    ])


def recency_bounds(features: DataFrame, transactions: DataFrame) -> DataFrame:
    """Recent counts must lie between 0 and the user's total."""
    totals = transactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    rows = features.join(totals, "user_id", "left")
    parts = []
    for days in (1, 7, 30):
        name = f"recent_transaction_count_{days}d"
        counted = rows.agg(F.expr(f"count_if({name} < 0)").alias("negative"), F.expr(f"count_if({name} > total)").alias("beyond"))
        parts.append(finding(counted.selectExpr("negative AS n"), "temporal_leakage", "negative_recency", "error", name, "negative values"))
        parts.append(finding(counted.selectExpr("beyond AS n"), "temporal_leakage", "recency_exceeds_total", "error", name, "values beyond the total"))
    return combine(parts)
