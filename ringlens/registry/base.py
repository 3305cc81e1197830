"""Shared pieces of the registered queries: the derived tables in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringlens.session import configure, cut_lineage
from ringlens.sources import star

Query = Callable[[SparkSession, str], DataFrame]

_CTES: list[tuple[str, str]] = []


def cte(name: str, body: str) -> None:
    """Define a named SQL step; later steps may use earlier ones."""
    _CTES.append((name, body))


def sql(query: str) -> str:
    """Prefix ``query`` with the defined steps it needs, directly or indirectly."""
    import re

    needed: set[str] = set()
    text = query
    for name, body in reversed(_CTES):
        if re.search(rf"\b{name}\b", text):
            needed.add(name)
            text += " " + body
    steps = [f"{name} AS MATERIALIZED ({body})" for name, body in _CTES if name in needed]
    return (f"WITH RECURSIVE {', '.join(steps)} " if steps else "") + query


_STAGES: dict[tuple, object] = {}


class Data:
    """The derived tables of one folder; each is planned once per query."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = configure(spark), folder
        self._planned: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in star.TABLE_BUILDERS:
            raise AttributeError(name)
        if name not in self._planned:
            self._planned[name] = star.TABLE_BUILDERS[name](self.spark, self.folder)
        return self._planned[name]

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in star.TABLE_BUILDERS}

    def keep(self, name: str, columns: Sequence[str]) -> None:
        """Store ``columns`` of a table for a query that reads it several times."""
        self._planned[name] = cut_lineage(getattr(self, name).select(*columns))

    def once(self, stage: str, build: Callable[[], object]) -> object:
        """The stored result of an earlier stage (feature files, model, communities) that several queries follow.

        It is built anew for another session or folder, and whenever an input file has changed.
        """
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        state = files.agg(F.max("modificationTime"), F.sum("length"), F.count(F.lit(1))).first()
        key = (self.spark.sparkContext.applicationId, self.folder, stage, *state)
        if key not in _STAGES:
            _STAGES[key] = build()
        return _STAGES[key]

    @property
    def scored(self) -> DataFrame:
        return star.scored_users(self.spark, self.folder)


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracle: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, build: Callable[[Data], DataFrame], oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"duplicate query {name}")
        self.queries[name] = lambda spark, folder: build(Data(spark, folder))
        if oracle is not None:
            self.oracle[name] = sql(oracle)


REGISTRY = Registry()


def case_list(values, index: str) -> str:
    """SQL picking from a fixed list by ``index`` modulo its length."""
    options = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({index}) % {len(values)} {options} END"


# --- The derived tables, as SQL --------------------------------------------------

from ringlens import schema as S  # noqa: E402

cte("first_line", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
cte("users_raw", f"""
SELECT 'USR_' || c_custkey AS user_id, DATE '1995-01-01' + (c_custkey % 365)::INT AS account_created_at,
  {case_list(S.USER_SEGMENTS, 'c_custkey')} AS user_segment, 'CITY_' || (c_custkey % 12) AS city,
  {case_list(S.AGE_GROUPS, 'c_custkey % 7')} AS age_group, c_acctbal < 0 AS is_abuse_account,
  CASE WHEN c_acctbal < 0 THEN 'RING_' || c_nationkey ELSE '' END AS ring_id,
  CASE WHEN c_acctbal < 0 THEN {case_list(S.RING_TYPES, 'c_nationkey')} ELSE '' END AS ring_type,
  CASE WHEN c_acctbal < 0 THEN 'RING_' || c_nationkey WHEN c_mktsegment = 'MACHINERY' THEN ''
    ELSE 'GRP_' || c_nationkey || '_' || c_mktsegment END AS group_id,
  CASE WHEN c_acctbal < 0 THEN 'abuse_ring' ELSE CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'family'
    WHEN 'BUILDING' THEN 'office' WHEN 'FURNITURE' THEN 'college' WHEN 'HOUSEHOLD' THEN 'hostel' ELSE '' END END AS group_type,
  CASE WHEN c_acctbal < 0 THEN abs(c_acctbal) ELSE 0.0::DOUBLE END AS estimated_abuse_value,
  CASE WHEN c_nationkey % 20 < 14 THEN 'train' WHEN c_nationkey % 20 < 17 THEN 'val' ELSE 'test' END AS split,
  'ADR_' || c_nationkey || '_' || floor(c_acctbal / 100)::BIGINT AS address_id, c_nationkey AS nation, c_custkey AS custkey
FROM customer""")
cte("users", """SELECT user_id, account_created_at, user_segment, city, age_group, is_abuse_account, ring_id, ring_type,
  group_id, group_type, estimated_abuse_value, split FROM users_raw""")
cte("txns", """
SELECT 'TXN_' || o_orderkey AS transaction_id, 'USR_' || o_custkey AS user_id,
  o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS ts, o_totalprice AS amount,
  'MER_' || l_suppkey AS merchant_id, 'PAY_' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m%d') AS payment_instrument_id,
  'DEV_' || l_suppkey || '_' || strftime(o_orderdate, '%Y%m') AS device_id, 'IP_' || l_partkey || '_' || l_returnflag AS ip_id,
  u.address_id,
  CASE WHEN l_discount = 0 THEN '' ELSE 'PROMO_' || round(l_discount * 100)::INT END AS promo_id,
  CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'refunded'
       WHEN l_returnflag = 'A' AND o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS transaction_status,
  coalesce(u.is_abuse_account, false) AND o_orderkey % 2 = 0 AS is_abuse_transaction,
  CASE WHEN coalesce(u.is_abuse_account, false) AND o_orderkey % 2 = 0 THEN u.ring_id ELSE '' END AS ring_id
FROM orders LEFT JOIN first_line ON l_orderkey = o_orderkey LEFT JOIN users_raw u ON u.custkey = o_custkey""")
cte("devices", f"""
SELECT DISTINCT 'DEV_' || l_suppkey || '_' || strftime(o_orderdate, '%Y%m') AS device_id,
  {case_list(S.DEVICE_TYPES, "l_suppkey + strftime(o_orderdate, '%Y%m')::INT")} AS device_type,
  date_trunc('month', o_orderdate)::DATE AS first_seen_at
FROM orders JOIN first_line ON l_orderkey = o_orderkey""")
cte("ips", f"""
SELECT DISTINCT 'IP_' || l_partkey || '_' || l_returnflag AS ip_id, {case_list(S.NETWORK_TYPES, 'l_partkey')} AS network_type,
  'CITY_' || (l_partkey % 12) AS city FROM orders JOIN first_line ON l_orderkey = o_orderkey""")
cte("addresses", f"""
SELECT DISTINCT address_id, {case_list(S.ADDRESS_TYPES, 'nation')} AS address_type FROM users_raw""")
cte("payment_instruments", f"""
SELECT DISTINCT 'PAY_' || l_suppkey || '_' || strftime(l_shipdate, '%Y%m%d') AS payment_instrument_id,
  {case_list(S.INSTRUMENT_TYPES, 'l_suppkey')} AS instrument_type FROM orders JOIN first_line ON l_orderkey = o_orderkey""")
cte("promotions", """
SELECT DISTINCT 'PROMO_' || round(l_discount * 100)::INT AS promo_id FROM orders
JOIN first_line ON l_orderkey = o_orderkey WHERE l_discount <> 0""")
cte("merchants", f"""
SELECT DISTINCT 'MER_' || l_suppkey AS merchant_id, {case_list(S.MERCHANT_CATEGORIES, 'l_suppkey')} AS merchant_category
FROM orders JOIN first_line ON l_orderkey = o_orderkey""")
cte("scored", """
SELECT user_id, is_abuse_account::INT AS label,
  (CASE WHEN is_abuse_account THEN 400000 + 600 * ((custkey * 7919) % 1000) ELSE 850 * ((custkey * 7919) % 1000) END)::DOUBLE
    / 1000000.0::DOUBLE AS prob
FROM users_raw""")
