"""Data set, graph and community summaries, and exploratory queries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import flag, present
from ringlens.functions.ordered import exact_quantiles
from ringlens.operators import projection as P
from ringlens.operators.data_checks import combine
from ringlens.session import cut_lineage


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return combine([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()])


def label_rates(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """``(entity, total, abuse, rate)`` for accounts and transactions."""
    def rate(df: DataFrame, name: str, column: str) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("total"), F.expr(f"count_if({column})").alias("abuse"), F.round(F.avg(flag(F.col(column))), 4).alias("rate")
        ).select(F.lit(name).alias("entity"), "*")

    return rate(users, "accounts", "is_abuse_account").unionByName(rate(transactions, "transactions", "is_abuse_transaction"))


def ring_sizes(users: DataFrame) -> DataFrame:
    return users.where("is_abuse_account").groupBy("ring_id").agg(
        F.count(F.lit(1)).alias("size"), F.min("ring_type").alias("ring_type"), F.sum("estimated_abuse_value").alias("value")
    )


def ring_stats(users: DataFrame) -> DataFrame:
    """One row: number of rings, size range, mean and median, total estimated value."""
    sizes = ring_sizes(users)
    median = exact_quantiles(sizes, [], "size", {"median": 0.5})
    return sizes.agg(
        F.count(F.lit(1)).alias("rings"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.round(F.avg("size"), 2).alias("mean_size"),
    ).withColumn("median_size", median.scalar()).withColumn(
        "total_value", users.agg(F.round(F.sum("estimated_abuse_value"), 2)).scalar()
    )


def rings_per_type(users: DataFrame) -> DataFrame:
    """Ring counts for every known ring type, 0 included."""
    known = users.sparkSession.createDataFrame([(t,) for t in S.RING_TYPES], "ring_type string")
    counts = ring_sizes(users).groupBy("ring_type").agg(F.count(F.lit(1)).alias("rings"))
    return known.join(counts, "ring_type", "full").na.fill(0, ["rings"])


def amount_stats(transactions: DataFrame) -> DataFrame:
    tails = exact_quantiles(transactions, [], "amount", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    moments = transactions.agg(F.round(F.avg("amount"), 2).alias("mean"), F.round(F.max("amount"), 2).alias("max"))
    return moments.withColumn("_t", tails.select(F.struct("*")).scalar()).selectExpr(
        "mean", "round(_t.median, 2) AS median", "round(_t.p90, 2) AS p90", "round(_t.p99, 2) AS p99", "max"
    )


def promotion_usage(transactions: DataFrame) -> DataFrame:
    used = transactions.groupBy("promo_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("real", present("promo_id"))
    return used.agg(
        F.expr("coalesce(sum(CASE WHEN real THEN rows END), 0)").alias("transactions_with_promo"),
        F.round(F.expr("sum(CASE WHEN real THEN rows ELSE 0 END) / sum(rows)"), 4).alias("promo_usage_rate"),
        F.expr("count_if(real)").alias("distinct_promos_used"),
    )


def users_per_entity(transactions: DataFrame, kinds: tuple[str, ...] = ("device", "ip", "address")) -> DataFrame:
    """``(kind, entity_id, users)``; nulls are no entity, a blank id counts as a value."""
    items = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(S.ENTITY_KINDS[k][0]).alias("entity_id")) for k in kinds])
    pairs = transactions.select("user_id", F.explode(items).alias("i")).select("i.kind", "i.entity_id", "user_id")
    return pairs.where("entity_id IS NOT NULL").distinct().groupBy("kind", "entity_id").agg(F.count(F.lit(1)).alias("users"))


def shared_infrastructure(transactions: DataFrame) -> DataFrame:
    return users_per_entity(transactions).groupBy("kind").agg(
        F.max("users").alias("max_users"), F.expr("count_if(users > 1)").alias("shared_by_several")
    )


def breakdown(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


# --- Graph ------------------------------------------------------------------------


def node_type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"))


def user_degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean, median and maximum number of edges at user nodes."""
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    users = nodes.where("node_type = 'user'").join(degree, "id", "left").na.fill(0, ["degree"])
    median = exact_quantiles(users, [], "degree", {"m": 0.5})
    return users.agg(F.round(F.avg("degree"), 4).alias("average_user_degree"), F.max("degree").alias("maximum_user_degree")).withColumn(
        "median_user_degree", median.scalar()
    )


def graph_size(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Total nodes and edges and the density of the simple undirected graph."""
    counted = nodes.agg(F.count(F.lit(1)).alias("total_nodes")).withColumn("total_edges", edges.agg(F.count(F.lit(1))).scalar())
    return counted.selectExpr(
        "total_nodes", "total_edges",
        "round(2 * total_edges / nullif(cast(total_nodes AS double) * (total_nodes - 1), 0), 8) AS density",
    )


# --- Money and time ---------------------------------------------------------------


def ring_losses(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per ring: amount of abuse transactions that did not fail, and the share per member."""
    loss = (
        transactions.where("is_abuse_transaction AND transaction_status <> 'failed'")
        .groupBy("ring_id").agg(F.sum("amount").alias("loss"))
    )
    return ring_sizes(users).join(loss, "ring_id", "left").selectExpr(
        "ring_id", "size", "round(coalesce(loss, 0D), 2) AS loss", "round(coalesce(loss, 0D) / size, 2) AS value_per_member"
    )


def daily_volume(rows: DataFrame, stamp: str = "timestamp") -> DataFrame:
    """Rows per calendar day between the first and last, empty days as 0."""
    counts = rows.groupBy(F.to_date(stamp).alias("day")).agg(F.count(F.lit(1)).alias("rows")).where("day IS NOT NULL")
    days = counts.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(counts, "day", "left").na.fill(0, ["rows"])


def clipped_histogram(df: DataFrame, column: str, *, bins: int = 60, clip: float = 0.99) -> DataFrame:
    """``(bin, rows)`` of ``column`` clipped at a quantile, equal bins from the minimum."""
    top = exact_quantiles(df, [], column, {"top": clip})
    clipped = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    low = clipped.agg(F.min("x"))
    placed = clipped.withColumn("_hi", top.scalar()).withColumn("_lo", low.scalar()).selectExpr(
        f"if(_hi > _lo, least(floor((least(x, _hi) - _lo) / ((_hi - _lo) / {bins})), {bins - 1}), 0) AS bin"
    )
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))


def value_histogram(df: DataFrame, column: str) -> DataFrame:
    """How often each integer value of ``column`` occurs."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def transactions_per_user(transactions: DataFrame) -> DataFrame:
    return transactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def top_promotions(transactions: DataFrame, n: int = 20) -> DataFrame:
    used = transactions.where(present("promo_id")).groupBy("promo_id").agg(F.count(F.lit(1)).alias("rows"))
    return used.orderBy(F.desc("rows"), "promo_id").limit(n)


# --- Communities ------------------------------------------------------------------


def community_table(assigned: DataFrame, users: DataFrame) -> DataFrame:
    """One row per community with its share of labelled accounts (evaluation only)."""
    label = users.selectExpr("user_id", "cast(is_abuse_account AS double) AS abuse")
    return assigned.join(label, "user_id", "left").groupBy("community_id").agg(
        F.count(F.lit(1)).alias("size"), F.first("community_density").alias("density"),
        F.avg(F.coalesce("abuse", F.lit(0.0))).alias("abuse_share"),
    )


def community_overview(communities: DataFrame) -> DataFrame:
    median = exact_quantiles(communities, [], "size", {"m": 0.5})
    return communities.agg(
        F.count(F.lit(1)).alias("communities"), F.min("size").alias("min_size"), F.max("size").alias("max_size"),
        F.round(F.avg("size"), 3).alias("mean_size"), F.expr("count_if(size = 1)").alias("singletons"),
        F.round(F.avg("density"), 6).alias("mean_density"),
    ).withColumn("median_size", median.scalar())


def largest_communities(communities: DataFrame, n: int = 10) -> DataFrame:
    return communities.orderBy(F.desc("size"), "community_id").limit(n).selectExpr(
        "community_id", "size", "round(density, 6) AS density", "round(abuse_share, 4) AS abuse_share"
    )


def legitimate_communities(communities: DataFrame, low: int = 15, high: int = 60, share: float = 0.05) -> DataFrame:
    """Mid-sized communities with hardly any labelled account, largest first."""
    return communities.where(F.col("size").between(low, high) & (F.col("abuse_share") < share)).orderBy(F.desc("size"), "community_id")


def ring_graph(transactions: DataFrame, users: DataFrame) -> P.UserGraph:
    """The projection of every ring's members, a view per ring: pairs with other users are not formed."""
    members = _ring_members(users).selectExpr("user_id", "ring_id AS view").distinct()
    return P.project_users(transactions.drop("ring_id").join(members, "user_id"))


def _ring_members(users: DataFrame) -> DataFrame:
    return users.where(F.col("is_abuse_account") & present("ring_id")).select("user_id", "ring_id")


def _repeated(users: DataFrame) -> DataFrame:
    """``(user_id, ring_id, copies)`` of members whose row comes more than once."""
    return cut_lineage(_ring_members(users).groupBy("user_id", "ring_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))


def ring_subgraph(graph: P.UserGraph, users: DataFrame) -> DataFrame:
    """Projection edges whose two ends belong to the same ring: ``(ring_id, a, b)`` of a ``ring_graph``.

    An edge comes once for every two rows of its ends in ``users``. Where all rows are single, no edge is shuffled.
    """
    ends = [_repeated(users).selectExpr(f"user_id AS {end}", "ring_id", f"copies AS copies_{end}") for end in ("a", "b")]
    times = F.expr("explode(sequence(1L, coalesce(copies_a, 1L) * coalesce(copies_b, 1L)))").alias("_copy")
    edges = graph.edges.select(F.col("view").alias("ring_id"), "a", "b").join(ends[0], ["ring_id", "a"], "left").join(ends[1], ["ring_id", "b"], "left")
    return edges.select("ring_id", "a", "b", times).drop("_copy")


def ring_edge_counts(graph: P.UserGraph, users: DataFrame) -> DataFrame:
    """``(ring_id, edges)``: the rows of ``ring_subgraph`` per ring that has any, without spelling them out."""
    return P.edge_rows(graph.links, _ring_members(users).withColumnRenamed("ring_id", "view")).selectExpr("view AS ring_id", "n AS edges")
