"""Betweenness by level-synchronous breadth-first search from many sources at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringlens.operators.projection import UserGraph, both_directions
from ringlens.session import cut_lineage


def pivots(nodes: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(view, source): per view the ``count`` users with the smallest salted hash."""
    hashed = nodes.withColumn("_h", F.md5(F.concat("user_id", F.lit(f"|{seed}"))))
    order = Window.partitionBy("view").orderBy("_h", "user_id")
    return hashed.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count).selectExpr("view", "user_id AS source")


def betweenness(graph: UserGraph, sources: DataFrame | None = None) -> DataFrame:
    """``(view, user_id, betweenness_centrality, betweenness_approx)``, normalised, 8 decimals.

    Exact from all nodes without ``sources``; from a table ``(view, source)`` such as :func:`pivots`
    gives, an estimate scaled up by nodes over sources. The caller chooses, not the size of the data.
    Each step extends every source's frontier by one join; path counts add up by (source,
    node), and the walk back accumulates dependencies from the deepest level.
    """
    arcs = cut_lineage(both_directions(graph.edges.select("view", "a", "b")).repartition("view", "u"))
    nodes = cut_lineage(graph.nodes)
    start = nodes.selectExpr("view", "user_id AS source") if sources is None else cut_lineage(sources.select("view", "source"))
    key = ["view", "source", "node"]
    levels = [cut_lineage(start.selectExpr("view", "source", "source AS node", "1D AS paths"))]
    while True:
        reached = (
            levels[-1].withColumnRenamed("node", "u").join(arcs, ["view", "u"])
            .groupBy("view", "source", F.col("v").alias("node"))
            .agg(F.sum("paths").alias("paths"))
            .join(levels[-1], key, "left_anti")
        )
        # A neighbour of level d lies on level d - 1, d or d + 1.
        if len(levels) > 1:
            reached = reached.join(levels[-2], key, "left_anti")
        reached = cut_lineage(reached)
        if reached.isEmpty():
            break
        levels.append(reached)

    settled: list[DataFrame] = []
    deeper: DataFrame | None = None
    for level in reversed(levels[1:]):
        if deeper is None:
            scored = level.withColumn("dependency", F.lit(0.0))
        else:
            received = (
                deeper.selectExpr("view", "source", "node AS u", "(1 + dependency) / paths AS share")
                .join(arcs, ["view", "u"])
                .groupBy("view", "source", F.col("v").alias("node"))
                .agg(F.sum("share").alias("share"))
            )
            scored = level.join(received, key, "left").selectExpr(
                *key, "paths", "paths * coalesce(share, 0D) AS dependency"
            )
        deeper = cut_lineage(scored)
        settled.append(deeper.groupBy("view", "node").agg(F.sum("dependency").alias("dependency")))

    used = start.groupBy("view").agg(F.count(F.lit(1)).alias("k"))
    sizes = nodes.groupBy("view").agg(F.count(F.lit(1)).alias("n")).join(used, "view", "left")
    table = nodes.join(F.broadcast(sizes), "view")
    if settled:
        total = settled[0]
        for part in settled[1:]:
            total = total.unionByName(part)
        total = total.groupBy("view", F.col("node").alias("user_id")).agg(F.sum("dependency").alias("dependency"))
        table = table.join(total, ["view", "user_id"], "left")
    else:
        table = table.withColumn("dependency", F.lit(0.0))
    scale = "(n / cast(k AS double)) / ((n - 1D) * (n - 2D))"
    return table.selectExpr(
        "view", "user_id",
        f"if(n > 2, round(coalesce(dependency, 0D) * {scale}, 8), 0D) AS betweenness_centrality",
        f"{str(sources is not None).lower()} AS betweenness_approx",
    )
