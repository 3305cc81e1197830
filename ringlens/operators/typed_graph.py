"""The typed graph of users, entities and transactions, as an edge and a node table.

Edges come only from transaction rows, so filtering the transactions first gives a graph
restricted to a split or a period. Label columns are never selected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import present, unpivot_ids

EDGE_COLUMNS = ("src", "dst", "edge_type", "weight")


def graph_columns(transactions: DataFrame) -> DataFrame:
    """Only the columns a graph may be built from."""
    return transactions.select(*S.GRAPH_TRANSACTION_COLUMNS)


def split_view(transactions: DataFrame, users: DataFrame, split: str) -> DataFrame:
    """Transactions of one split's users."""
    members = users.where(F.col("split") == split).select("user_id")
    return transactions.join(members, "user_id", "left_semi")


def user_entity_edges(transactions: DataFrame) -> DataFrame:
    """User-entity edges weighted by the number of transactions using the entity."""
    columns = {edge: column for column, edge, _, _ in S.ENTITY_KINDS.values()}
    item = unpivot_ids(columns, kind="edge_type", value="dst").alias("item")
    return (
        graph_columns(transactions)
        .select(F.col("user_id").alias("src"), item)
        .select("src", "item.dst", "item.edge_type")
        .where(present("dst"))
        .groupBy(*EDGE_COLUMNS[:3])
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def _single_edges(transactions: DataFrame, source: str, target: str, edge_type: str) -> DataFrame:
    return (
        transactions.where(present(target))
        .selectExpr(f"{source} AS src", f"{target} AS dst", f"'{edge_type}' AS edge_type", "1L AS weight")
    )


def transaction_edges(transactions: DataFrame) -> DataFrame:
    return _single_edges(transactions, "user_id", "transaction_id", S.TRANSACTION_EDGE)


def merchant_edges(transactions: DataFrame) -> DataFrame:
    return _single_edges(transactions, "transaction_id", "merchant_id", S.MERCHANT_EDGE)


def promotion_edges(transactions: DataFrame) -> DataFrame:
    return _single_edges(transactions, "transaction_id", "promo_id", S.PROMOTION_EDGE)


def build_edges(transactions: DataFrame, *, include_transaction_nodes: bool = True) -> DataFrame:
    edges = user_entity_edges(transactions)
    if include_transaction_nodes:
        for part in (transaction_edges, merchant_edges, promotion_edges):
            edges = edges.unionByName(part(graph_columns(transactions)))
    return edges


_TARGET_TYPES = {edge: node for _, edge, node, _ in S.ENTITY_KINDS.values()} | {
    S.TRANSACTION_EDGE: "transaction", S.MERCHANT_EDGE: "merchant", S.PROMOTION_EDGE: "promotion",
}


def build_nodes(edges: DataFrame, transactions: DataFrame) -> DataFrame:
    """Users of the view plus everything an edge points to."""
    target = F.element_at(F.create_map(*[F.lit(x) for kv in _TARGET_TYPES.items() for x in kv]), F.col("edge_type"))
    people = transactions.select(F.col("user_id").alias("id"), F.lit("user").alias("node_type"))
    return edges.select(F.col("dst").alias("id"), target.alias("node_type")).unionByName(people).distinct()


def nodes_of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type).orderBy("id")


def edges_of_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") == edge_type)
