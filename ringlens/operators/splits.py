"""Group-aware train / validation / test assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import present
from ringlens.functions.ordered import running_totals


def split_units(users: DataFrame) -> DataFrame:
    """``(user_id, unit)``: the group, or the user alone when ungrouped."""
    return users.select(
        "user_id",
        F.when(present("group_id"), F.col("group_id")).otherwise(F.concat(F.lit("__solo__"), "user_id")).alias("unit"),
    )


def assign_splits(
    users: DataFrame, pinned_groups: DataFrame | None = None, *,
    fractions: dict[str, float] = S.SPLIT_FRACTIONS, seed: int = 42,
) -> DataFrame:
    """``(user_id, unit, split)``; a unit never spans splits and pinned groups go to test.

    Units are put in the order of a salted hash and cut where their running user count
    passes the target shares, with the test share reduced by the pinned users. The running
    count is distributed, and the shares miss their targets by at most one unit.
    """
    units = split_units(users)
    pinned = (
        pinned_groups.select(F.col("group_id").alias("unit")).distinct().withColumn("pinned", F.lit(True))
        if pinned_groups is not None
        else units.select("unit").limit(0).withColumn("pinned", F.lit(True))
    )
    sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).join(pinned, "unit", "left")
    position = F.conv(F.substring(F.md5(F.concat("unit", F.lit(f"|{seed}"))), 1, 13), 16, 10).cast("double")
    free = sizes.where("pinned IS NULL").select("unit", "size", position.alias("position"))
    slots = free.groupBy("position").agg(F.sum("size").alias("size"))
    placed = running_totals(slots, [], "position", ["size"])

    total = users.agg(F.count(F.lit(1)))
    held = sizes.where("pinned").agg(F.coalesce(F.sum("size"), F.lit(0)))
    share = placed.withColumn("_total", total.scalar().cast("double")).withColumn("_held", held.scalar().cast("double")).selectExpr(
        "position", "(cum_size - size / 2.0D) / (_total - _held) AS at",
        f"{fractions['train']}D AS w_train", f"{fractions['val']}D AS w_val",
        f"greatest({fractions['test']}D - _held / _total, 0D) AS w_test",
    )
    cut = share.selectExpr(
        "position",
        "CASE WHEN at < w_train / (w_train + w_val + w_test) THEN 'train' "
        "WHEN at < (w_train + w_val) / (w_train + w_val + w_test) THEN 'val' ELSE 'test' END AS split",
    )
    by_unit = free.join(cut, "position").select("unit", "split").unionByName(
        sizes.where("pinned").select("unit", F.lit("test").alias("split"))
    )
    return units.join(by_unit, "unit").select("user_id", "unit", "split")


def split_tables(users: DataFrame, transactions: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    members = users.where(F.col("split") == split)
    return members, transactions.join(members.select("user_id"), "user_id", "left_semi")


def split_manifest(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per split: users, transactions, abuse accounts, rings and ring types."""
    per_user = transactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    ring = F.when(F.col("is_abuse_account") & present("ring_id"), F.col("ring_id"))
    kind = F.when(F.col("is_abuse_account") & present("ring_type"), F.col("ring_type"))
    return (
        users.join(per_user, "user_id", "left")
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("users"), F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"),
            F.expr("count_if(is_abuse_account)").alias("abuse_accounts"),
            F.countDistinct(ring).alias("rings"),
            F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("ring_types"),
        )
    )


def rings_spanning_splits(users: DataFrame) -> DataFrame:
    return (
        users.where(F.col("is_abuse_account") & present("ring_id"))
        .select("ring_id", "split").distinct()
        .groupBy("ring_id").agg(F.count(F.lit(1)).alias("splits"))
        .where("splits > 1")
    )


def split_identity(users: DataFrame) -> DataFrame:
    """User ids with their label and split, the identity the feature tables must reproduce."""
    return users.selectExpr("split", "user_id", "cast(is_abuse_account AS int) AS label")


def split_identity_summary(users: DataFrame) -> DataFrame:
    return users.groupBy("split").agg(
        F.count(F.lit(1)).alias("users"), F.expr("count_if(is_abuse_account)").alias("positives")
    )
