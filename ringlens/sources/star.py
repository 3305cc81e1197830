"""The abuse model's eight tables derived from star-schema order data.

Orders become transactions, customers become accounts; devices, networks, addresses,
instruments, merchants and promotions are derived from an order's first line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ringlens import schema as S

# Declared so that planning never opens a file to infer a schema.
STAR_SCHEMAS = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, "
        "l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_star(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _pick(values: Sequence[str], index: str) -> str:
    """SQL choosing from a list by ``index`` modulo its length."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({listed}), cast(({index}) % {len(values)} + 1 AS int))"


def _accounts(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, folder, "customer").selectExpr(
        "concat('USR_', c_custkey) AS user_id",
        "date_add(DATE'1995-01-01', cast(c_custkey % 365 AS int)) AS account_created_at",
        f"{_pick(S.USER_SEGMENTS, 'c_custkey')} AS user_segment",
        "concat('CITY_', c_custkey % 12) AS city",
        f"{_pick(S.AGE_GROUPS, 'c_custkey % 7')} AS age_group",
        "c_acctbal < 0 AS is_abuse_account",
        "if(c_acctbal < 0, concat('RING_', c_nationkey), '') AS ring_id",
        f"if(c_acctbal < 0, {_pick(S.RING_TYPES, 'c_nationkey')}, '') AS ring_type",
        "CASE WHEN c_acctbal < 0 THEN concat('RING_', c_nationkey) WHEN c_mktsegment = 'MACHINERY' THEN '' "
        "ELSE concat('GRP_', c_nationkey, '_', c_mktsegment) END AS group_id",
        "CASE WHEN c_acctbal < 0 THEN 'abuse_ring' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'family' "
        "WHEN c_mktsegment = 'BUILDING' THEN 'office' WHEN c_mktsegment = 'FURNITURE' THEN 'college' "
        "WHEN c_mktsegment = 'HOUSEHOLD' THEN 'hostel' ELSE '' END AS group_type",
        "if(c_acctbal < 0, abs(c_acctbal), 0D) AS estimated_abuse_value",
        "CASE WHEN c_nationkey % 20 < 14 THEN 'train' WHEN c_nationkey % 20 < 17 THEN 'val' ELSE 'test' END AS split",
        "concat('ADR_', c_nationkey, '_', cast(floor(c_acctbal / 100) AS bigint)) AS address_id",
        "c_nationkey AS nation",
        "c_custkey AS custkey",
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return _accounts(spark, folder).select(*S.TABLES["users"].fieldNames())


def _orders_with_first_line(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_star(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS o_orderkey",
        "struct(l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_returnflag, l_discount) AS line",
    )
    first = lines.groupBy("o_orderkey").agg({"line": "min"}).selectExpr("o_orderkey", "`min(line)`.*")
    return read_star(spark, folder, "orders").join(first, "o_orderkey", "left")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    owners = _accounts(spark, folder).selectExpr(
        "custkey AS o_custkey", "is_abuse_account AS owner_abuse", "ring_id AS owner_ring", "address_id"
    )
    abuse = "(coalesce(owner_abuse, false) AND o_orderkey % 2 = 0)"
    return _orders_with_first_line(spark, folder).join(owners, "o_custkey", "left").selectExpr(
        "concat('TXN_', o_orderkey) AS transaction_id",
        "concat('USR_', o_custkey) AS user_id",
        "timestamp_seconds(unix_seconds(cast(o_orderdate AS timestamp)) + (o_orderkey * 7919) % 86400) AS timestamp",
        "o_totalprice AS amount",
        "concat('MER_', l_suppkey) AS merchant_id",
        "concat('PAY_', l_suppkey, '_', date_format(l_shipdate, 'yyyyMMdd')) AS payment_instrument_id",
        "concat('DEV_', l_suppkey, '_', date_format(o_orderdate, 'yyyyMM')) AS device_id",
        "concat('IP_', l_partkey, '_', l_returnflag) AS ip_id",
        "address_id",
        "if(l_discount = 0, '', concat('PROMO_', cast(round(l_discount * 100) AS int))) AS promo_id",
        "CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'refunded' "
        "WHEN l_returnflag = 'A' AND o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS transaction_status",
        f"{abuse} AS is_abuse_transaction",
        f"if({abuse}, owner_ring, '') AS ring_id",
    )


def devices(spark: SparkSession, folder: str) -> DataFrame:
    keys = _orders_with_first_line(spark, folder).where("l_suppkey IS NOT NULL").selectExpr(
        "l_suppkey", "date_format(o_orderdate, 'yyyyMM') AS month"
    )
    return keys.distinct().selectExpr(
        "concat('DEV_', l_suppkey, '_', month) AS device_id",
        f"{_pick(S.DEVICE_TYPES, 'l_suppkey + cast(month AS int)')} AS device_type",
        "concat('FPG_', l_suppkey % 50) AS device_fingerprint_group",
        "to_date(concat(month, '01'), 'yyyyMMdd') AS first_seen_at",
    )


def ips(spark: SparkSession, folder: str) -> DataFrame:
    keys = _orders_with_first_line(spark, folder).where("l_partkey IS NOT NULL").select("l_partkey", "l_returnflag")
    return keys.distinct().selectExpr(
        "concat('IP_', l_partkey, '_', l_returnflag) AS ip_id",
        f"{_pick(S.NETWORK_TYPES, 'l_partkey')} AS network_type",
        "concat('CITY_', l_partkey % 12) AS city",
        "concat('NET_', l_partkey % 40) AS network_cluster",
    )


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    return _accounts(spark, folder).select("address_id", "nation").distinct().selectExpr(
        "address_id",
        f"{_pick(S.ADDRESS_TYPES, 'nation')} AS address_type",
        "concat('CITY_', nation % 12) AS city",
        "concat('HH_', nation) AS household_group",
    )


def payment_instruments(spark: SparkSession, folder: str) -> DataFrame:
    keys = _orders_with_first_line(spark, folder).where("l_suppkey IS NOT NULL").selectExpr(
        "l_suppkey", "date_format(l_shipdate, 'yyyyMMdd') AS day"
    )
    return keys.distinct().selectExpr(
        "concat('PAY_', l_suppkey, '_', day) AS payment_instrument_id",
        f"{_pick(S.INSTRUMENT_TYPES, 'l_suppkey')} AS instrument_type",
        "concat('ISS_', l_suppkey % 20) AS issuer_group",
    )


def promotions(spark: SparkSession, folder: str) -> DataFrame:
    keys = _orders_with_first_line(spark, folder).where("l_discount <> 0").selectExpr(
        "cast(round(l_discount * 100) AS int) AS percent"
    )
    return keys.distinct().selectExpr(
        "concat('PROMO_', percent) AS promo_id",
        "if(percent % 2 = 0, 'cashback', 'discount') AS promo_type",
        "cast(percent * 10 AS double) AS discount_value",
        "cast(percent AS double) AS discount_percentage",
        "'all' AS eligibility_type",
        "percent * 100 AS max_usage",
    )


def merchants(spark: SparkSession, folder: str) -> DataFrame:
    keys = _orders_with_first_line(spark, folder).where("l_suppkey IS NOT NULL").select("l_suppkey")
    return keys.distinct().selectExpr(
        "concat('MER_', l_suppkey) AS merchant_id",
        f"{_pick(S.MERCHANT_CATEGORIES, 'l_suppkey')} AS merchant_category",
        "concat('CITY_', l_suppkey % 12) AS city",
    )


TABLE_BUILDERS = {
    "users": users, "transactions": transactions, "devices": devices, "ips": ips,
    "addresses": addresses, "payment_instruments": payment_instruments,
    "promotions": promotions, "merchants": merchants,
}


def star_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All eight tables, lazily planned."""
    return {name: build(spark, folder) for name, build in TABLE_BUILDERS.items()}


def scored_users(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, label, prob) with a deterministic stand-in score, higher for labelled users."""
    noise = "((custkey * 7919) % 1000)"
    return _accounts(spark, folder).selectExpr(
        "user_id",
        "cast(is_abuse_account AS int) AS label",
        f"cast(if(is_abuse_account, 400000 + 600 * {noise}, 850 * {noise}) AS double) / 1000000D AS prob",
    )
