"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ringlens.llm.store import cut_lineage


def _stored(df: DataFrame) -> DataFrame:
    """A written table of few files: links are few against the documents that the partition number is set for."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.coalesce(max(1, partitions // 8)))


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of the links (a, b); the label is the smallest node reachable.

    Each round hangs the larger neighbours of every node on its smallest neighbour (large star), then the
    smaller ones (small star); the links never become more, and O(log^2 n) rounds leave stars. Rounds are
    written to the shared folder, so are the minima, which leaves a hub's partition free to be split in the joins; a node's
    neighbours are never gathered in one place.
    """
    edges = _stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = _stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lowest = _stored(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = _stored(large.join(lowest, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")))
        # done when every node hangs on one root and no root hangs on another node
        roles = edges.select(F.col("u").alias("n"), F.col("v").alias("root"), F.lit(True).alias("hangs")).union(
            edges.select(F.col("v").alias("n"), F.lit(None), F.lit(False))).groupBy("n").agg(
                F.min("root").alias("low"), F.max("root").alias("high"), (F.max("hangs") & ~F.min("hangs")).alias("both"))
        if roles.where("low < high OR both").agg(F.count("*")).first()[0] == 0:
            break
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(edges.select(F.col("v"), F.col("v"))).distinct()
