"""Class-wise distributions, separability and leakage checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.functions.ordered import exact_quantiles
from ringlens.operators.data_checks import combine, finding

ACCOUNT_COLUMNS = (
    "txn_count", "avg_amount", "total_amount", "n_devices", "n_ips", "n_payments",
    "n_merchant_categories", "promo_rate", "active_days_span",
)
SEPARABILITY_COLUMNS = ("n_devices", "n_ips", "n_payments", "avg_amount", "txn_count")
OVERLAP_FLOOR = 0.30


def long_features(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Unpivot numeric columns to (feature, value), keeping ``keep``."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(items).alias("item")).select(*keep, "item.feature", "item.value")


def overlap(values: DataFrame, bins: int = 30) -> DataFrame:
    """``(feature, overlap)`` of the two classes' histograms on their joint range.

    ``values`` is (feature, abuse, value). The last bin is closed; an empty class or a zero
    range gives 1. The per-feature ranges are one row per feature and are broadcast.
    """
    known = values.where("value IS NOT NULL")
    ranges = known.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.expr("count_if(abuse)").alias("n_abuse"), F.expr("count_if(NOT abuse)").alias("n_legit"),
    )
    counted = (
        known.join(F.broadcast(ranges), "feature")
        .selectExpr(
            "feature", "abuse",
            f"if(hi > lo, least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}), 0) AS bin",
        )
        .groupBy("feature", "bin")
        .agg(F.expr("count_if(abuse)").alias("in_abuse"), F.expr("count_if(NOT abuse)").alias("in_legit"))
    )
    shared = counted.join(F.broadcast(ranges), "feature").groupBy("feature").agg(
        F.sum(F.expr("least(in_abuse / greatest(n_abuse, 1), in_legit / greatest(n_legit, 1))")).alias("shared"),
        F.expr("bool_or(n_abuse = 0 OR n_legit = 0 OR hi <= lo)").alias("trivial"),
    )
    return shared.selectExpr("feature", "if(trivial, 1D, shared) AS overlap")


def class_summary(values: DataFrame) -> DataFrame:
    """Mean, median, spread, tails and range per feature and class, 4 decimals."""
    keys = ["feature", "abuse"]
    moments = values.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    tails = exact_quantiles(values, keys, "value", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    names = ("mean", "median", "std", "p10", "p90", "min", "max")
    return moments.join(tails, keys).select(*keys, *[F.round(n, 4).alias(n) for n in names])


def low_overlap(overlaps: DataFrame, module: str, check: str) -> DataFrame:
    rows = overlaps.where(F.col("overlap") < OVERLAP_FLOOR).withColumn("n", F.lit(1))
    context = F.create_map(F.lit("overlap"), F.round("overlap", 4).cast("string"))
    return finding(rows, module, check, "warning", F.col("feature"), "feature separates the classes", context)


def account_values(accounts: DataFrame, columns: Iterable[str] = ACCOUNT_COLUMNS) -> DataFrame:
    return long_features(accounts.withColumnRenamed("is_abuse_account", "abuse"), list(columns), "abuse")


def distribution_checks(accounts: DataFrame) -> DataFrame:
    return low_overlap(overlap(account_values(accounts)), "distribution", "single_feature_separability")


# --- Leakage ----------------------------------------------------------------------


def category_counts(users: DataFrame, transactions: DataFrame, devices: DataFrame, ips: DataFrame) -> DataFrame:
    """``(feature, value, rows, abuse_rows)`` for account and transaction categories.

    Transactions are counted per (device or network, label) before the lookup join, so a
    busy device does not become a busy join key.
    """
    label = users.select("user_id", F.col("is_abuse_account").alias("abuse"))
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("city", "user_segment", "age_group")])
    accounts = (
        users.select(F.col("is_abuse_account").alias("abuse"), F.explode(items).alias("item"))
        .groupBy("item.feature", "item.value", "abuse").agg(F.count(F.lit(1)).alias("rows"))
    )
    labelled = transactions.select("user_id", "device_id", "ip_id", "transaction_status").join(label, "user_id", "left").withColumn(
        "abuse", F.coalesce("abuse", F.lit(False))
    )

    def looked_up(key: str, table: DataFrame, column: str) -> DataFrame:
        counted = labelled.groupBy(key, "abuse").agg(F.count(F.lit(1)).alias("rows"))
        return counted.join(table.select(key, column), key, "left").select(
            F.lit(column).alias("feature"), F.col(column).alias("value"), "abuse", "rows"
        )

    status = labelled.groupBy("transaction_status", "abuse").agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("transaction_status").alias("feature"), F.col("transaction_status").alias("value"), "abuse", "rows"
    )
    return (
        combine([accounts, looked_up("device_id", devices, "device_type"), looked_up("ip_id", ips, "network_type"), status])
        .where("value IS NOT NULL")
        .groupBy("feature", "value")
        .agg(F.sum("rows").alias("rows"), F.sum(F.expr("if(abuse, rows, 0L)")).alias("abuse_rows"))
    )


def categorical_leakage(counts: DataFrame, *, dominance: float = 0.98, min_rows: int = 20) -> DataFrame:
    """Values held almost only by abuse, among columns where both classes occur."""
    both = counts.groupBy("feature").agg(F.sum("abuse_rows").alias("a"), F.sum("rows").alias("t")).where("a > 0 AND a < t")
    return (
        counts.join(F.broadcast(both.select("feature")), "feature")
        .where((F.col("rows") >= min_rows) & (F.col("abuse_rows") / F.col("rows") >= dominance))
        .selectExpr("feature", "value", "rows", "abuse_rows / rows AS abuse_share", "'high' AS severity")
    )


def transaction_values(users: DataFrame, transactions: DataFrame) -> DataFrame:
    label = users.select("user_id", F.col("is_abuse_account").alias("abuse"))
    rows = transactions.join(label, "user_id", "left").select(
        F.coalesce("abuse", F.lit(False)).alias("abuse"), "amount", F.hour("timestamp").alias("hour")
    )
    return long_features(rows, ["amount", "hour"], "abuse")


def transaction_overlaps(users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Overlap of amounts (30 bins) and of the hour of day (24 bins)."""
    values = transaction_values(users, transactions)
    return overlap(values.where("feature = 'amount'")).unionByName(overlap(values.where("feature = 'hour'"), 24))


def whitelist_guard(columns: DataFrame) -> DataFrame:
    """Label columns among the allowed features; ``columns`` is (name) or (name, rows read)."""
    hits = _counted(columns.where(F.col("name").isin(*S.FORBIDDEN_FEATURES))).groupBy("name").agg(F.max("n").alias("n"))
    return finding(hits, "leakage", "whitelist_guard", "error", F.col("name"), "label column in the whitelist")


def leakage_checks(users: DataFrame, transactions: DataFrame, devices: DataFrame, ips: DataFrame,
                   accounts: DataFrame, whitelist: DataFrame) -> DataFrame:
    leaks = categorical_leakage(category_counts(users, transactions, devices, ips)).withColumn("n", F.lit(1))
    separable = overlap(account_values(accounts, SEPARABILITY_COLUMNS))
    return combine([
        whitelist_guard(whitelist),
        finding(leaks, "leakage", "categorical_leakage", "warning", F.concat_ws("=", "feature", "value"), "value nearly exclusive to abuse"),
        low_overlap(transaction_overlaps(users, transactions), "leakage", "transaction_separability"),
        low_overlap(separable, "leakage", "account_feature_separability"),
    ])


# --- Feature tables ---------------------------------------------------------------


def column_names(df: DataFrame) -> DataFrame:
    """``(name, rows)``: the columns of ``df`` with the number of rows read."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.explode(names).alias("name"), "rows")


def _counted(columns: DataFrame) -> DataFrame:
    """Add ``n``, the rows a column holds; a name alone, or one of an empty table, counts once."""
    return columns.withColumn("n", F.greatest(F.col("rows"), F.lit(1)) if "rows" in columns.columns else F.lit(1))


def missing_splits(table: DataFrame, expected: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Splits without any feature row."""
    seen = table.agg(F.collect_set("split").alias("seen"))  # at most one entry per split
    lacking = F.array_except(F.array(*[F.lit(s) for s in expected]), "seen")
    rows = seen.select(F.explode(lacking).alias("split")).withColumn("n", F.lit(1))
    return finding(rows, "feature_leakage", "feature_table_exists", "error", F.col("split"), "feature table missing")


def feature_name_audit(columns: DataFrame) -> DataFrame:
    """Label columns and names with a label-like token, matched on whole tokens."""
    features = _counted(columns.where(~F.col("name").isin("user_id", "label")))
    tokens = F.split(F.lower("name"), r"[_\W]+")
    listed = F.array(*[F.lit(t) for t in S.SUSPICIOUS_TOKENS])
    return combine([
        finding(features.where(F.col("name").isin(*S.FORBIDDEN_FEATURES)),
                "feature_leakage", "explicit_label", "error", F.col("name"), "label column"),
        finding(features.where(F.arrays_overlap(tokens, listed)),
                "feature_leakage", "suspicious_name", "error", F.col("name"), "name suggests a label"),
    ])


def label_is_binary(table: DataFrame) -> DataFrame:
    odd = table.where("label IS NULL OR label NOT IN (0, 1)").agg(F.count(F.lit(1)).alias("n"))
    return finding(odd, "feature_leakage", "label_binary", "error", "label", "labels other than 0 and 1")


def feature_quality(table: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing rate, distinct values and moments per feature and split."""
    keys = ["feature", "split"]
    values = long_features(table, features, "split")
    shares = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("rows"))
    spread = shares.groupBy(*keys).agg(
        F.count("value").alias("unique_count"), F.sum("rows").alias("n"),
        F.sum(F.expr("if(value IS NULL, rows, 0L)")).alias("missing"),
        F.max(F.expr("if(value IS NULL, 0L, rows)")).alias("top"),
    )
    moments = values.groupBy(*keys).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
    )
    medians = exact_quantiles(values, keys, "value", {"median": 0.5})
    return spread.join(moments, keys).join(medians, keys, "left").selectExpr(
        *keys, "missing / n AS missing_rate", "unique_count", "min", "max", "mean", "median", "std",
        "top / nullif(n - missing, 0) AS top_share",
    )


def feature_flags(quality: DataFrame) -> DataFrame:
    """``(feature, flag)``: constant or near-constant in train, or shifted between train and test."""
    train = quality.where("split = 'train'").selectExpr("feature", "unique_count", "top_share", "mean AS m", "std AS s")
    test = quality.where("split = 'test'").selectExpr("feature", "mean AS mt")
    flags = train.join(test, "feature", "left").selectExpr("feature", """array_compact(array(
        CASE WHEN unique_count <= 1 THEN 'constant' WHEN unique_count <= 2 AND top_share > 0.99 THEN 'near_constant' END,
        CASE WHEN s > 1e-9 AND abs(m - mt) / s > 1 THEN 'distribution_shift' END)) AS flags""")
    return flags.select("feature", F.explode("flags").alias("flag"))
