from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import behaviour as B
from ringlens.registry.base import REGISTRY, cte

cte("beh_base", """
SELECT user_id, count(*) AS transaction_count, avg(amount) AS average_transaction_amount, median(amount) AS median_transaction_amount,
  stddev_samp(amount) AS transaction_amount_std, avg((coalesce(promo_id, '') <> '')::INT) AS promo_usage_rate,
  count(DISTINCT merchant_id) AS unique_merchant_count, count(DISTINCT nullif(promo_id, '')) AS unique_promo_count,
  count(DISTINCT payment_instrument_id) AS unique_payment_instrument_count, count(DISTINCT device_id) AS unique_device_count,
  count(DISTINCT ip_id) AS unique_ip_count, count(DISTINCT address_id) AS unique_address_count,
  count(*) / greatest(date_diff('microsecond', min(ts), max(ts)) / 86400e6, 1.0) AS transaction_frequency,
  avg((transaction_status = 'failed')::INT) AS failed_transaction_rate, avg((transaction_status = 'refunded')::INT) AS refund_rate,
  avg((isodow(ts) >= 6)::INT) AS weekend_activity_rate, avg((hour(ts) < 6 OR hour(ts) >= 22)::INT) AS night_activity_rate,
  max(ts) AS decision_time
FROM txns GROUP BY user_id""")
cte("beh_aged", """
SELECT t.*, b.decision_time, date_diff('microsecond', t.ts, b.decision_time) / 86400e6 AS age
FROM txns t JOIN beh_base b USING (user_id) WHERE t.ts <= b.decision_time""")
cte("beh_recent", """
SELECT user_id, count(*) FILTER (age <= 1) AS recent_transaction_count_1d, count(*) FILTER (age <= 7) AS recent_transaction_count_7d,
  count(*) FILTER (age <= 30) AS recent_transaction_count_30d, round(sum(amount) FILTER (age <= 30), 2) AS recent_amount_sum_30d
FROM beh_aged GROUP BY user_id""")
cte("beh_entities", """
SELECT user_id, count(DISTINCT e) AS recent_unique_entity_count_30d FROM (
  SELECT user_id, unnest([device_id, ip_id, address_id, payment_instrument_id]) AS e FROM beh_aged WHERE age <= 30)
WHERE e IS NOT NULL AND e <> '' GROUP BY user_id""")
cte("beh_device", """
SELECT user_id, greatest(date_diff('microsecond', min(first_seen_at)::TIMESTAMP, any_value(decision_time)) / 86400e6, 0)
  AS days_since_first_device_seen
FROM beh_aged JOIN devices USING (device_id) GROUP BY user_id""")
cte("behaviour", """
SELECT u.user_id, b.* EXCLUDE (user_id, decision_time),
  date_diff('microsecond', u.account_created_at::TIMESTAMP, b.decision_time) / 86400e6 AS account_age_days,
  r.* EXCLUDE (user_id), e.* EXCLUDE (user_id), d.* EXCLUDE (user_id)
FROM users u LEFT JOIN beh_base b ON b.user_id = u.user_id LEFT JOIN beh_recent r ON r.user_id = u.user_id
LEFT JOIN beh_entities e ON e.user_id = u.user_id LEFT JOIN beh_device d ON d.user_id = u.user_id""")

_INTEGER = {n for n in S.BASELINE_FEATURES if n.startswith("unique_") or "_count" in n}


def _digits(name: str) -> int:
    """Enough digits to avoid ties, few enough to absorb summation order."""
    return {"transaction_amount_std": 6, "average_transaction_amount": 7}.get(name, 8)


def _expr(name: str) -> str:
    if name in _INTEGER:
        return f"coalesce({name}, 0)::BIGINT AS {name}"
    return f"round(coalesce({name}, 0)::DOUBLE, {_digits(name)}) AS {name}"


def _col(name: str):
    return F.col(name).cast("bigint").alias(name) if name in _INTEGER else F.round(name, _digits(name)).alias(name)


_ACTIVITY = {
    "transaction_count", "average_transaction_amount", "transaction_amount_std", "promo_usage_rate",
    "transaction_frequency", "failed_transaction_rate", "refund_rate", "weekend_activity_rate", "night_activity_rate",
}


def _part(d, name):
    """The part of the feature table holding ``name``, for every user."""
    txns = d.transactions
    if name in _ACTIVITY:
        part = B.activity_features(txns)
    elif name == "median_transaction_amount":
        part = B.median_amounts(txns)
    elif name == "account_age_days":
        users = d.users.join(B.decision_times(txns), "user_id", "left")
        age = B.days_between(F.col("decision_time"), F.col("account_created_at"))
        return users.select("user_id", age.alias(name)).na.fill(0)
    elif name.startswith("unique_"):
        part = B.diversity_features(B.used_ids(txns))
    elif name == "recent_unique_entity_count_30d":
        part = B.recent_entity_features(B.used_ids(txns), B.decision_times(txns))
    elif name == "days_since_first_device_seen":
        part = B.device_age_features(B.used_ids(txns), d.devices, B.decision_times(txns))
    else:
        part = B.recency_features(txns, B.decision_times(txns))
    return d.users.select("user_id").join(part.select("user_id", name), "user_id", "left").na.fill(0)


_ORDER = (
    *S.STATIC_FEATURES, "recent_transaction_count_1d", "recent_transaction_count_7d", "recent_transaction_count_30d",
    "recent_amount_sum_30d", "recent_unique_entity_count_30d", "days_since_first_device_seen",
)
for _i, _name in enumerate(_ORDER, start=1):
    REGISTRY.add(
        f"beh_{_i:02d}_{_name}",
        lambda d, name=_name: _part(d, name).select("user_id", _col(name)),
        f"SELECT user_id, {_expr(_name)} FROM behaviour",
    )

REGISTRY.add(
    "beh_24_decision_time_guard",
    lambda d: B.as_of(d.transactions, B.decision_times(d.transactions.where(F.col("transaction_status") == "success")))
    .groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("amount")),
    """SELECT t.user_id, count(*) AS n, round(sum(amount), 4) AS amount FROM txns t
       JOIN (SELECT user_id, max(ts) AS cut FROM txns WHERE transaction_status = 'success' GROUP BY user_id) c
         ON c.user_id = t.user_id AND t.ts <= c.cut GROUP BY t.user_id""",
)

cte("account_features", """
SELECT u.user_id, u.is_abuse_account, coalesce(t.txn_count, 0) AS txn_count, coalesce(avg_amount, 0) AS avg_amount,
  coalesce(total_amount, 0) AS total_amount, coalesce(n_devices, 0) AS n_devices, coalesce(n_ips, 0) AS n_ips,
  coalesce(n_payments, 0) AS n_payments, coalesce(n_merchant_categories, 0) AS n_merchant_categories,
  coalesce(promo_rate, 0) AS promo_rate, coalesce(active_days_span, 0) AS active_days_span
FROM users u LEFT JOIN (
  SELECT user_id, count(*) AS txn_count, avg(amount) AS avg_amount, sum(amount) AS total_amount,
    count(DISTINCT device_id) AS n_devices, count(DISTINCT ip_id) AS n_ips, count(DISTINCT payment_instrument_id) AS n_payments,
    count(DISTINCT merchant_id) AS n_merchant_categories, avg((coalesce(promo_id, '') <> '')::INT) AS promo_rate,
    date_diff('microsecond', min(ts), max(ts)) / 86400e6 AS active_days_span
  FROM txns GROUP BY user_id) t USING (user_id)""")
_ROUNDED = ("avg_amount", "total_amount", "promo_rate", "active_days_span")
REGISTRY.add(
    "beh_25_account_features",
    lambda d: B.account_features(d.users, d.transactions).select(
        "*", *[F.round(c, 7).alias(f"{c}_r") for c in _ROUNDED]).drop(*_ROUNDED),
    "SELECT * EXCLUDE (avg_amount, total_amount, promo_rate, active_days_span), "
    + ", ".join(f"round({c}, 7) AS {c}_r" for c in _ROUNDED) + " FROM account_features",
)
REGISTRY.add(
    "beh_all_features",
    lambda d: B.behavioural_features(d.users, d.transactions, d.devices).select("user_id", *[_col(n) for n in S.BASELINE_FEATURES]),
    "SELECT user_id, " + ", ".join(_expr(n) for n in S.BASELINE_FEATURES) + " FROM behaviour",
)
