"""Data quality checks. Every check yields finding rows; no row means nothing was found.

A finding is ``(module, check, severity, subject, n, message, context)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.exprs import count_where, present

# References, required columns and vocabularies of the tables.
FOREIGN_KEYS = (
    ("user_id", "users", False), ("merchant_id", "merchants", False),
    ("payment_instrument_id", "payment_instruments", False), ("device_id", "devices", False),
    ("ip_id", "ips", False), ("address_id", "addresses", False), ("promo_id", "promotions", True),
)
REQUIRED = {
    "users": ("user_segment", "city", "age_group", "account_created_at"),
    "transactions": (
        "user_id", "timestamp", "amount", "merchant_id", "payment_instrument_id", "device_id",
        "ip_id", "address_id", "transaction_status",
    ),
}
ENUMS = (
    ("users", "user_segment", S.USER_SEGMENTS), ("devices", "device_type", S.DEVICE_TYPES),
    ("ips", "network_type", S.NETWORK_TYPES), ("addresses", "address_type", S.ADDRESS_TYPES),
    ("payment_instruments", "instrument_type", S.INSTRUMENT_TYPES),
    ("merchants", "merchant_category", S.MERCHANT_CATEGORIES),
    ("transactions", "transaction_status", S.TRANSACTION_STATUSES),
)




def finding(df: DataFrame, module: str, check: str, severity: str, subject: str | Column, message: str | Column,
            context: Column | None = None) -> DataFrame:
    """Findings from rows holding a count ``n``; rows with n = 0 vanish. ``message`` follows the count."""
    return df.where("n > 0").select(
        F.lit(module).alias("module"), F.lit(check).alias("check"), F.lit(severity).alias("severity"),
        (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
        F.col("n").cast("bigint").alias("n"),
        F.concat_ws(" ", F.lit(subject) if isinstance(subject, str) else subject, F.col("n").cast("string"), F.lit(message) if isinstance(message, str) else message).alias("message"),
        (context if context is not None else F.lit(None).cast("map<string,string>")).alias("context"),
    )


def combine(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _counts(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """(subject, n) for several conditions counted in one pass over ``df``."""
    one = df.agg(*[count_where(c).alias(f"c{i}") for i, c in enumerate(conditions.values())])
    items = F.array(*[F.struct(F.lit(k).alias("subject"), F.col(f"c{i}").alias("n")) for i, k in enumerate(conditions)])
    return one.select(F.explode(items).alias("item")).select("item.subject", "item.n")


def _one(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


# --- Structure --------------------------------------------------------------------


def primary_key_duplicates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Extra rows per key value (a value occurring three times counts two)."""
    parts = []
    for name, key in S.PRIMARY_KEYS.items():
        if key not in tables[name].columns:
            parts.append(finding(
                tables[name].sparkSession.range(1).selectExpr("1L AS n"),
                "integrity", "primary_key", "error", f"{name}.{key}", "key column missing"))
            continue
        repeated = tables[name].groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra").alias("n"))
        parts.append(finding(repeated, "integrity", "primary_key", "error", f"{name}.{key}", "duplicate values"))
    return combine(parts)


def primary_key_nulls(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        _counts(tables[name], {f"{name}.{key}": F.col(key).isNull()})
        for name, key in S.PRIMARY_KEYS.items() if key in tables[name].columns
    ]
    return finding(combine(parts), "integrity", "primary_key", "error", F.col("subject"), "null values")


def foreign_keys(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Transaction references without a parent row, with up to five example values.

    The seven columns are unpivoted in one pass and counted per value before they meet the union of all
    parents' keys, so a value carried by many rows is one row in the join.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c, *_ in FOREIGN_KEYS])
    values = tables["transactions"].select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("rows"))
    keys = combine(tables[parent].select(F.lit(column).alias("column"), F.col(S.PRIMARY_KEYS[parent]).alias("value"))
                   for column, parent, _ in FOREIGN_KEYS)
    blank_allowed = [c for c, _, blank in FOREIGN_KEYS if blank]
    missing = values.join(keys, ["column", "value"], "left_anti").where((F.col("value") != "") | ~F.col("column").isin(*blank_allowed))
    rank = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    first = missing.select("column", "value").withColumn("rank", rank).where("rank <= 5")
    examples = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("examples"))
    totals = missing.groupBy("column").agg(F.sum("rows").alias("n")).join(examples, "column")
    parents = F.create_map(*[F.lit(x) for column, parent, _ in FOREIGN_KEYS for x in (column, parent)])
    return finding(totals, "integrity", "foreign_key", "error", F.concat(F.lit("transactions."), "column"),
                   F.concat(F.lit("values not in "), parents[F.col("column")]), F.create_map(F.lit("examples"), F.col("examples")))


def required_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [_counts(tables[name], {f"{name}.{c}": F.col(c).isNull() for c in columns}) for name, columns in REQUIRED.items()]
    return finding(combine(parts), "integrity", "null_check", "error", F.col("subject"), "nulls")


def enum_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of distinct values outside each vocabulary."""
    parts = []
    for name, column, allowed in ENUMS:
        bad = tables[name].where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(column).distinct()
        parts.append(finding(_one(bad), "integrity", "enum_check", "error", f"{name}.{column}", "invalid values"))
    return combine(parts)


def amounts(transactions: DataFrame) -> DataFrame:
    counted = _counts(transactions, {"transactions.amount": F.col("amount") <= 0})
    return finding(counted, "integrity", "amount_check", "error", F.col("subject"), "non-positive amounts")


def unparseable_timestamps(transactions: DataFrame) -> DataFrame:
    stamp = F.col("timestamp")
    if dict(transactions.dtypes)["timestamp"] == "string":
        stamp = F.try_to_timestamp("timestamp")
    counted = _counts(transactions, {"transactions.timestamp": stamp.isNull()})
    return finding(counted, "integrity", "timestamp_check", "error", F.col("subject"), "unparseable timestamps")


def timestamps_in_span(transactions: DataFrame, start: str, end: str) -> DataFrame:
    stamp = F.col("timestamp")
    outside = (stamp < F.lit(start).cast("timestamp")) | (stamp >= F.lit(end).cast("timestamp"))
    counted = _counts(transactions, {"transactions.timestamp": outside})
    return finding(counted, "integrity", "timestamp_check", "warning", F.col("subject"), f"outside [{start}, {end})")


def integrity(tables: Mapping[str, DataFrame], start: str, end: str) -> DataFrame:
    transactions = tables["transactions"]
    return combine([
        primary_key_duplicates(tables), primary_key_nulls(tables), foreign_keys(tables), required_values(tables),
        enum_values(tables), amounts(transactions), unparseable_timestamps(transactions),
        timestamps_in_span(transactions, start, end),
    ])


# --- Labels -----------------------------------------------------------------------


def abuse_without_ring(users: DataFrame) -> DataFrame:
    abuse = F.col("is_abuse_account")
    counted = _counts(users, {"users.ring_id": abuse & ~present("ring_id"), "users.ring_type": abuse & ~present("ring_type")})
    return finding(counted, "labels", "abuse_ring_identity", "error", F.col("subject"), "abuse accounts without it")


def legit_with_ring(users: DataFrame) -> DataFrame:
    counted = _counts(users, {"users.ring_id": ~F.col("is_abuse_account") & present("ring_id")})
    return finding(counted, "labels", "legit_ring_identity", "error", F.col("subject"), "legitimate accounts with a ring")


def ring_types(users: DataFrame) -> DataFrame:
    """Ring types outside the vocabulary, and vocabulary entries no abuse account has."""
    seen = users.where(F.col("is_abuse_account") & present("ring_type")).select("ring_type").distinct()
    known = users.sparkSession.createDataFrame([(t,) for t in S.RING_TYPES], "ring_type string")
    unknown = _one(seen.exceptAll(known))
    absent = _one(known.exceptAll(seen))
    return combine([
        finding(unknown, "labels", "ring_type_vocabulary", "error", "users.ring_type", "unknown ring types"),
        finding(absent, "labels", "ring_type_coverage", "error", "users.ring_type", "ring types missing"),
    ])


def abuse_transactions_of_others(users: DataFrame, transactions: DataFrame) -> DataFrame:
    abusers = users.where("is_abuse_account").select("user_id")
    per_user = transactions.where("is_abuse_transaction").groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    stray = per_user.join(abusers, "user_id", "left_anti").agg(F.sum("rows").alias("n"))
    return finding(stray, "labels", "abuse_transaction_owner", "error", "transactions.user_id", "abuse transactions of other accounts")


def abuse_transaction_rings(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Abuse transactions without a ring, or with another ring than their owner's."""
    rows = transactions.where("is_abuse_transaction").groupBy("user_id", "ring_id").agg(F.count(F.lit(1)).alias("rows"))
    blank = rows.where(~present("ring_id")).agg(F.sum("rows").alias("n"))
    owners = users.select("user_id", F.col("ring_id").alias("owner_ring"))
    differing = (
        rows.where(present("ring_id")).join(owners, "user_id").where("ring_id <> coalesce(owner_ring, '')").agg(F.sum("rows").alias("n"))
    )
    return combine([
        finding(blank, "labels", "abuse_transaction_ring", "error", "transactions.ring_id", "abuse transactions without a ring"),
        finding(differing, "labels", "ring_consistency", "error", "transactions.ring_id", "rings differing from the owner's"),
    ])


def estimated_values(users: DataFrame) -> DataFrame:
    value = F.col("estimated_abuse_value")
    negative = _counts(users, {"users.estimated_abuse_value": value < 0})
    legit = _counts(users, {"users.estimated_abuse_value": ~F.col("is_abuse_account") & (value > 0)})
    return combine([
        finding(negative, "labels", "negative_value", "error", F.col("subject"), "negative values"),
        finding(legit, "labels", "legit_value", "warning", F.col("subject"), "legitimate accounts with a value"),
    ])


def inactive_abusers(users: DataFrame, transactions: DataFrame) -> DataFrame:
    active = transactions.where("is_abuse_transaction").select("user_id").distinct()
    idle = users.where("is_abuse_account").join(active, "user_id", "left_anti")
    return finding(_one(idle), "labels", "abuse_without_transactions", "info", "users.user_id", "abuse accounts without abuse transactions")


def labels(users: DataFrame, transactions: DataFrame) -> DataFrame:
    return combine([
        abuse_without_ring(users), legit_with_ring(users), ring_types(users),
        abuse_transactions_of_others(users, transactions), abuse_transaction_rings(users, transactions),
        estimated_values(users), inactive_abusers(users, transactions),
    ])


# --- Splits -----------------------------------------------------------------------


def _expected_splits(users: DataFrame) -> DataFrame:
    expected = users.sparkSession.createDataFrame(list(S.SPLIT_FRACTIONS.items()), "split string, target double")
    counts = users.groupBy("split").agg(
        F.count(F.lit(1)).alias("users"), F.expr("count_if(is_abuse_account)").alias("abusers")
    )
    return expected.join(counts, "split", "left").na.fill(0, ["users", "abusers"])


def empty_splits(users: DataFrame) -> DataFrame:
    empty = _expected_splits(users).where("users = 0").withColumn("n", F.lit(1))
    return finding(empty, "splits", "split_nonempty", "error", F.col("split"), "split without users")


def group_isolation(users: DataFrame) -> DataFrame:
    """Rings of abuse accounts, and any other group, found in more than one split."""
    def spanning(rows: DataFrame, column: str) -> DataFrame:
        pairs = rows.where(present(column)).select(column, "split").distinct()
        return _one(pairs.groupBy(column).agg(F.count(F.lit(1)).alias("splits")).where("splits > 1"))

    return combine([
        finding(spanning(users.where("is_abuse_account"), "ring_id"), "splits", "ring_isolation", "error", "users.ring_id", "rings in several splits"),
        finding(spanning(users, "group_id"), "splits", "group_isolation", "error", "users.group_id", "groups in several splits"),
    ])


def split_fractions(users: DataFrame) -> DataFrame:
    total = users.agg(F.count(F.lit(1)))
    rows = _expected_splits(users).withColumn("_total", total.scalar()).withColumn("n", F.col("users"))
    context = F.create_map(
        F.lit("achieved"), F.round(F.col("users") / F.col("_total"), 4).cast("string"),
        F.lit("target"), F.col("target").cast("string"),
    )
    return finding(rows, "splits", "split_fraction", "info", F.col("split"), "users", context)


def splits_without_abuse(users: DataFrame) -> DataFrame:
    rows = _expected_splits(users).where("abusers = 0").withColumn("n", F.lit(1))
    return finding(rows, "splits", "split_has_abuse", "warning", F.col("split"), "split without abuse accounts")


def splits(users: DataFrame) -> DataFrame:
    return combine([empty_splits(users), group_isolation(users), split_fractions(users), splits_without_abuse(users)])


# --- Aggregate --------------------------------------------------------------------


def summarize(findings: DataFrame) -> DataFrame:
    """Errors, warnings and ``ok`` per module."""
    return findings.groupBy("module").agg(
        F.expr("count_if(severity = 'error')").alias("errors"),
        F.expr("count_if(severity = 'warning')").alias("warnings"),
        F.expr("count_if(severity = 'error') = 0").alias("ok"),
    )


def overall(findings: DataFrame) -> DataFrame:
    return findings.agg(
        F.expr("count_if(severity = 'error')").alias("total_errors"),
        F.expr("count_if(severity = 'warning')").alias("total_warnings"),
        F.expr("count_if(severity = 'error') = 0").alias("ok"),
    )
