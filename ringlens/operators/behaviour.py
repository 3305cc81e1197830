"""Behavioural features: one row per user, including users without transactions.

Each function aggregates with map-side combining first. Distinct counts group by
(user, value) before (user), so a very active user is spread over many tasks, and the
median uses :func:`exact_quantiles` instead of gathering one user's amounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import count_where, days_between, flag, present, unpivot_ids
from ringlens.functions.ordered import exact_quantiles

# Recency windows in days.
RECENT_DAYS = (1, 7, 30)

_ID_COLUMNS = {
    "merchant": "merchant_id", "promo": "promo_id", "payment_instrument": "payment_instrument_id",
    "device": "device_id", "ip": "ip_id", "address": "address_id",
}


def decision_times(transactions: DataFrame) -> DataFrame:
    """Each user's decision time: the last transaction."""
    return transactions.groupBy("user_id").agg(F.max("timestamp").alias("decision_time"))


def as_of(transactions: DataFrame, times: DataFrame) -> DataFrame:
    """Transactions not later than the user's decision time, which is added as a column."""
    return transactions.join(times, "user_id").where(F.col("timestamp") <= F.col("decision_time"))


def activity_features(transactions: DataFrame) -> DataFrame:
    """Counts, amounts, rates and the active span; needs a single combining shuffle."""
    stamp = F.col("timestamp")
    night = (F.hour(stamp) < 6) | (F.hour(stamp) >= 22)
    span = days_between(F.max(stamp), F.min(stamp))
    return transactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.avg("amount").alias("average_transaction_amount"),
        F.stddev_samp("amount").alias("transaction_amount_std"),
        F.avg(flag(present("promo_id"))).alias("promo_usage_rate"),
        (F.count(F.lit(1)) / F.greatest(span, F.lit(1.0))).alias("transaction_frequency"),
        F.avg(flag(F.col("transaction_status") == "failed")).alias("failed_transaction_rate"),
        F.avg(flag(F.col("transaction_status") == "refunded")).alias("refund_rate"),
        F.avg(flag(F.weekday(stamp) >= 5)).alias("weekend_activity_rate"),
        F.avg(flag(night)).alias("night_activity_rate"),
        F.max(stamp).alias("decision_time"),
    )


def median_amounts(transactions: DataFrame) -> DataFrame:
    return exact_quantiles(transactions, ["user_id"], "amount", {"median_transaction_amount": 0.5})


def used_ids(transactions: DataFrame) -> DataFrame:
    """One row per (user, id): which roles the id had, and when an entity was last used."""
    item = unpivot_ids(_ID_COLUMNS).alias("item")
    long = transactions.select("user_id", "timestamp", item).select("user_id", "timestamp", "item.kind", "item.value")
    kept = long.where(F.col("value").isNotNull() & ((F.col("kind") != "promo") | (F.col("value") != "")))
    entity = F.col("kind").isin(list(S.ENTITY_KINDS)) & (F.col("value") != "")
    return kept.groupBy("user_id", "value").agg(
        *[F.max(flag(F.col("kind") == k)).alias(f"is_{k}") for k in _ID_COLUMNS],
        F.max(F.when(entity, F.col("timestamp"))).alias("entity_last_used"),
    )


def diversity_features(ids: DataFrame) -> DataFrame:
    """Distinct merchants, promotions, instruments, devices, networks and addresses."""
    return ids.groupBy("user_id").agg(
        *[F.sum(f"is_{k}").cast("bigint").alias(f"unique_{k}_count") for k in _ID_COLUMNS]
    )


def recent_entity_features(ids: DataFrame, times: DataFrame) -> DataFrame:
    """Distinct non-blank entities of all four kinds together in the last 30 days."""
    recent = days_between(F.col("decision_time"), F.col("entity_last_used")) <= 30
    return (
        ids.where(F.col("entity_last_used").isNotNull())
        .join(times, "user_id")
        .groupBy("user_id")
        .agg(count_where(recent).alias("recent_unique_entity_count_30d"))
    )


def recency_features(transactions: DataFrame, times: DataFrame) -> DataFrame:
    rows = as_of(transactions.select("user_id", "timestamp", "amount"), times)
    age = days_between(F.col("decision_time"), F.col("timestamp"))
    return rows.groupBy("user_id").agg(
        *[count_where(age <= d).alias(f"recent_transaction_count_{d}d") for d in RECENT_DAYS],
        F.round(F.sum(F.when(age <= 30, F.col("amount"))), 2).alias("recent_amount_sum_30d"),
    )


def device_age_features(ids: DataFrame, devices: DataFrame, times: DataFrame) -> DataFrame:
    """Days from the earliest sighting of any of the user's devices to the decision time."""
    owned = ids.where((F.col("is_device") == 1.0) & F.col("entity_last_used").isNotNull()).select(
        "user_id", F.col("value").alias("device_id")
    )
    earliest = (
        owned.join(devices.select("device_id", "first_seen_at"), "device_id")
        .groupBy("user_id")
        .agg(F.min("first_seen_at").alias("first_seen"))
    )
    age = days_between(F.col("decision_time"), F.col("first_seen"))
    return earliest.join(times, "user_id").select(
        "user_id", F.greatest(age, F.lit(0.0)).alias("days_since_first_device_seen")
    )


def behavioural_features(users: DataFrame, transactions: DataFrame, devices: DataFrame) -> DataFrame:
    """``user_id`` plus the 23 behavioural features, missing values as 0."""
    activity = activity_features(transactions)
    times = activity.select("user_id", "decision_time")
    ids = used_ids(transactions)
    table = users.select("user_id", "account_created_at")
    for part in (
        activity, median_amounts(transactions), diversity_features(ids), recency_features(transactions, times),
        recent_entity_features(ids, times), device_age_features(ids, devices, times),
    ):
        table = table.join(part, "user_id", "left")
    age = days_between(F.col("decision_time"), F.col("account_created_at"))
    return table.withColumn("account_age_days", age).select("user_id", *S.BASELINE_FEATURES).na.fill(0)


def account_features(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per-account summary behind the distribution checks, with the label attached.

    ``n_merchant_categories`` counts merchants, and a null id is not a value.
    """
    ids = used_ids(transactions)
    base = transactions.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.avg("amount").alias("avg_amount"),
        F.sum("amount").alias("total_amount"),
        F.avg(flag(present("promo_id"))).alias("promo_rate"),
        days_between(F.max("timestamp"), F.min("timestamp")).alias("active_days_span"),
    )
    kinds = {"n_devices": "device", "n_ips": "ip", "n_payments": "payment_instrument", "n_merchant_categories": "merchant"}
    counts = diversity_features(ids).select(
        "user_id", *[F.col(f"unique_{k}_count").alias(name) for name, k in kinds.items()]
    )
    return (
        users.select("user_id", "is_abuse_account")
        .join(base, "user_id", "left")
        .join(counts, "user_id", "left")
        .na.fill(0, [
            "txn_count", "avg_amount", "total_amount", "promo_rate", "active_days_span", *kinds,
        ])
        .select(
            "user_id", "txn_count", "avg_amount", "total_amount", "n_devices", "n_ips", "n_payments",
            "n_merchant_categories", "promo_rate", "active_days_span", "is_abuse_account",
        )
    )
