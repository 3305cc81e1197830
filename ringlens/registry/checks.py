from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import behaviour as B
from ringlens.operators import data_checks as D
from ringlens.operators import distribution as X
from ringlens.operators import graph_checks as GC
from ringlens.operators import splits as SP
from ringlens.operators import typed_graph as G
from ringlens.plans import validation
from ringlens.registry.base import REGISTRY, cte
from ringlens.registry.graph import split_graph
from ringlens.session import shared_folder

add = REGISTRY.add
START, END = "1995-06-01", "2001-01-01"

# --- Splits -----------------------------------------------------------------------

cte("units", "SELECT user_id, CASE WHEN group_id <> '' THEN group_id ELSE '__solo__' || user_id END AS unit FROM users")


def _split_sql(p: str, pins: str) -> None:
    cte(f"{p}sizes", f"SELECT unit, count(*) AS size, unit IN ({pins}) AS pinned FROM units GROUP BY unit")
    cte(f"{p}slots", f"""SELECT position, sum(size) AS size FROM (SELECT ('0x' || substr(md5(unit || '|42'), 1, 13))::BIGINT AS position, size
        FROM {p}sizes WHERE NOT pinned) GROUP BY position""")
    cte(f"{p}cut", f"""SELECT position, (cum - size / 2.0::DOUBLE) / (total - held) AS place, 0.7::DOUBLE AS wa, 0.15::DOUBLE AS wb,
        greatest(0.15::DOUBLE - held / total, 0) AS wc FROM (SELECT position, size, (sum(size) OVER (ORDER BY position))::DOUBLE AS cum FROM {p}slots),
        (SELECT sum(size)::DOUBLE AS total, coalesce(sum(size) FILTER (pinned), 0)::DOUBLE AS held FROM {p}sizes)""")
    cte(f"{p}assigned", f"""SELECT user_id, unit, CASE WHEN pinned THEN 'test' WHEN place < wa / (wa + wb + wc) THEN 'train'
        WHEN place < (wa + wb) / (wa + wb + wc) THEN 'val' ELSE 'test' END AS split
        FROM units JOIN {p}sizes USING (unit) LEFT JOIN {p}cut ON position = ('0x' || substr(md5(unit || '|42'), 1, 13))::BIGINT AND NOT pinned""")


_split_sql("sp_", "'none'")
_split_sql("pin_", "SELECT ring_id FROM users WHERE ring_id LIKE 'RING_1%'")
_MANIFEST = """SELECT {split} AS split, count(*) AS users, coalesce(sum(n), 0)::BIGINT AS transactions, count(*) FILTER (is_abuse_account) AS abuse_accounts,
  count(DISTINCT nullif(ring_id, '')) FILTER (is_abuse_account) AS rings,
  coalesce(array_to_string(list_sort(list(DISTINCT ring_type) FILTER (is_abuse_account AND ring_type <> '')), ','), '') AS ring_types
  FROM users u LEFT JOIN (SELECT user_id, count(*) AS n FROM txns GROUP BY user_id) USING (user_id) GROUP BY ALL"""

add("spl_01_group_split", lambda d: SP.assign_splits(d.users), "SELECT * FROM sp_assigned")
add("spl_02_pinned_groups",
    lambda d: SP.assign_splits(d.users, d.users.where("ring_id LIKE 'RING_1%'").select(F.col("ring_id").alias("group_id"))),
    "SELECT * FROM pin_assigned")
add("spl_03_split_users", lambda d: SP.split_tables(d.users, d.transactions, "val")[0].select("user_id", "split"),
    "SELECT user_id, split FROM users WHERE split = 'val'")
add("spl_03_split_transactions", lambda d: SP.split_tables(d.users, d.transactions, "val")[1].select("transaction_id", "user_id"),
    "SELECT transaction_id, user_id FROM txns JOIN users USING (user_id) WHERE split = 'val'")
add("spl_04_split_manifest", lambda d: SP.split_manifest(d.users, d.transactions), _MANIFEST.format(split="split"))
add("spl_04_rings_spanning_splits", lambda d: SP.rings_spanning_splits(d.users.withColumn("split", F.expr("if(city = 'CITY_3', 'test', split)"))),
    """SELECT ring_id, count(DISTINCT CASE WHEN city = 'CITY_3' THEN 'test' ELSE split END) AS splits FROM users
       WHERE is_abuse_account AND ring_id <> '' GROUP BY ring_id HAVING splits > 1""")
add("spl_05_split_identity", lambda d: SP.split_identity(d.users), "SELECT split, user_id, is_abuse_account::INT AS label FROM users")
add("spl_05_split_identity_summary", lambda d: SP.split_identity_summary(d.users),
    "SELECT split, count(*) AS users, count(*) FILTER (is_abuse_account) AS positives FROM users GROUP BY split")

# --- Tables with planted defects ----------------------------------------------------
# The derived tables are clean by construction, so the checks run on copies in which whole
# classes of rows are damaged by a rule.

_USER_DEFECTS = {
    "ring_id": "CASE WHEN NOT is_abuse_account AND k % 50 = 0 THEN 'RING_X' WHEN is_abuse_account AND k % 3 = 0 THEN '' ELSE ring_id END",
    "ring_type": "CASE WHEN is_abuse_account AND k % 5 = 0 THEN 'unheard_of' WHEN is_abuse_account AND k % 7 = 0 THEN '' "
                 "WHEN ring_type = 'indirect_multihop' THEN 'direct_infrastructure' ELSE ring_type END",
    "split": "CASE WHEN split = 'val' THEN 'train' WHEN k % 40 = 1 THEN 'test' ELSE split END",
    "estimated_abuse_value": "CASE WHEN is_abuse_account AND k % 7 = 0 THEN -5.0 WHEN NOT is_abuse_account AND k % 60 = 0 THEN 10.0 ELSE estimated_abuse_value END",
    "user_segment": "CASE WHEN k % 90 = 0 THEN 'alien' WHEN k % 91 = 0 THEN 'robot' ELSE user_segment END",
    "city": "CASE WHEN k % 80 = 0 THEN NULL ELSE city END",
    "user_id": "CASE WHEN k % 200 = 5 THEN NULL ELSE user_id END",
}
_TXN_DEFECTS = {
    "user_id": "CASE WHEN k % 333 = 0 THEN 'USR_X' ELSE user_id END",
    "amount": "CASE WHEN k % 250 = 0 THEN -1.0 ELSE amount END",
    "transaction_status": "CASE WHEN k % 400 = 0 THEN 'odd' ELSE transaction_status END",
    "is_abuse_transaction": "CASE WHEN k % 97 = 0 THEN true ELSE is_abuse_transaction END",
    "ring_id": "CASE WHEN is_abuse_transaction AND k % 20 = 0 THEN 'RING_Z' ELSE ring_id END",
    "promo_id": "CASE WHEN k % 150 = 0 THEN 'PROMO_X' ELSE promo_id END",
}
_USER_COLUMNS = list(S.TABLES["users"].fieldNames())
_TXN_COLUMNS = [c for c in S.TABLES["transactions"].fieldNames() if c != "timestamp"]


def _damage(columns, defects):
    return ", ".join(f"{defects[c]} AS {c}" if c in defects else c for c in columns)


def damaged(d):
    users = d.users.selectExpr("*", "cast(substr(user_id, 5) AS bigint) AS k").selectExpr(
        *[f"{_USER_DEFECTS[c].replace('-5.0', '-5D').replace('10.0', '10D')} AS {c}" if c in _USER_DEFECTS else c for c in _USER_COLUMNS])
    rows = d.transactions.selectExpr("*", "cast(substr(transaction_id, 5) AS bigint) AS k").selectExpr(
        "k", "if(k % 700 = 0, NULL, timestamp) AS timestamp",
        *[f"{_TXN_DEFECTS[c].replace('-1.0', '-1D')} AS {c}" if c in _TXN_DEFECTS else c for c in _TXN_COLUMNS])
    rows = rows.unionByName(rows.where("k % 500 = 0")).drop("k")
    return {**d.tables, "users": users, "transactions": rows}


cte("users_b", f"SELECT {_damage(_USER_COLUMNS, _USER_DEFECTS)} FROM (SELECT *, substr(user_id, 5)::BIGINT AS k FROM users)")
cte("txns_b1", f"""SELECT k, CASE WHEN k % 700 = 0 THEN NULL ELSE ts END AS ts, {_damage(_TXN_COLUMNS, _TXN_DEFECTS)}
FROM (SELECT *, substr(transaction_id, 5)::BIGINT AS k FROM txns)""")
cte("txns_b", "SELECT * FROM txns_b1 UNION ALL SELECT * FROM txns_b1 WHERE k % 500 = 0")

_SHORT = ("check", "severity", "subject", "n")
_FINDING_SQL: dict[str, str] = {}


def findings_query(name, build, *rows):
    """Register a check; ``rows`` are (check, severity, subject, count query) expected in SQL."""
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS check, '{s}' AS severity, {subject if subject.startswith('(') else repr(subject)} AS subject, n::BIGINT AS n FROM ({q}) WHERE n > 0"
        for c, s, subject, q in rows
    )
    union = union.replace(" AS check", ' AS "check"')
    _FINDING_SQL[name] = union
    add(name, lambda d: build(d).select(*_SHORT), union)


_SQL_TABLES = {"users": "users_b", "transactions": "txns_b"}


def _sql_table(name):
    return _SQL_TABLES.get(name, name)


_KEYED = {k: v for k, v in S.PRIMARY_KEYS.items()}
findings_query(
    "val_01_primary_key_duplicates", lambda d: D.primary_key_duplicates(damaged(d)),
    *[("primary_key", "error", f"{t}.{k}", f"SELECT coalesce(sum(c - 1), 0) AS n FROM (SELECT count(*) AS c FROM {_sql_table(t)} GROUP BY {k})")
      for t, k in _KEYED.items()])
findings_query(
    "val_02_primary_key_nulls", lambda d: D.primary_key_nulls(damaged(d)),
    *[("primary_key", "error", f"{t}.{k}", f"SELECT count(*) AS n FROM {_sql_table(t)} WHERE {k} IS NULL") for t, k in _KEYED.items()])
findings_query(
    "val_03_foreign_keys", lambda d: D.foreign_keys(damaged(d)),
    *[("foreign_key", "error", f"transactions.{c}", f"""SELECT count(*) AS n FROM txns_b t WHERE NOT EXISTS
        (SELECT 1 FROM {_sql_table(parent)} p WHERE p.{S.PRIMARY_KEYS[parent]} = t.{c}) {f"AND coalesce(t.{c}, '') <> ''" if blank else ''}""")
      for c, parent, blank in D.FOREIGN_KEYS])
add("val_03_foreign_key_examples",
    lambda d: D.foreign_keys(damaged(d)).where("subject = 'transactions.promo_id'").select("subject", F.col("context")["examples"].alias("examples")),
    "SELECT 'transactions.promo_id' AS subject, 'PROMO_X' AS examples")
findings_query(
    "val_04_required_values", lambda d: D.required_values(damaged(d)),
    *[("null_check", "error", f"{t}.{c}", f"SELECT count(*) AS n FROM {_sql_table(t)} WHERE {'ts' if c == 'timestamp' else c} IS NULL")
      for t, cs in D.REQUIRED.items() for c in cs])
findings_query(
    "val_05_enum_values", lambda d: D.enum_values(damaged(d)),
    *[("enum_check", "error", f"{t}.{c}", f"SELECT count(DISTINCT {c}) AS n FROM {_sql_table(t)} WHERE {c} NOT IN ({', '.join(repr(v) for v in allowed)})")
      for t, c, allowed in D.ENUMS])
findings_query("val_06_amounts", lambda d: D.amounts(damaged(d)["transactions"]),
               ("amount_check", "error", "transactions.amount", "SELECT count(*) AS n FROM txns_b WHERE amount <= 0"))
findings_query("val_07_unparseable_timestamps", lambda d: D.unparseable_timestamps(damaged(d)["transactions"].withColumn(
                   "timestamp", F.coalesce(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("not a time")))),
               ("timestamp_check", "error", "transactions.timestamp", "SELECT count(*) AS n FROM txns_b WHERE ts IS NULL"))
findings_query("val_08_timestamps_in_span", lambda d: D.timestamps_in_span(damaged(d)["transactions"], START, END),
               ("timestamp_check", "warning", "transactions.timestamp",
                f"SELECT count(*) AS n FROM txns_b WHERE ts < TIMESTAMP '{START}' OR ts >= TIMESTAMP '{END}'"))


def _lab(fn):
    return lambda d: (lambda t: fn(t["users"], t["transactions"]))(damaged(d))


findings_query("val_09_abuse_without_ring", _lab(lambda u, t: D.abuse_without_ring(u)),
               *[("abuse_ring_identity", "error", f"users.{c}", f"SELECT count(*) AS n FROM users_b WHERE is_abuse_account AND coalesce({c}, '') = ''")
                 for c in ("ring_id", "ring_type")])
findings_query("val_10_legit_with_ring", _lab(lambda u, t: D.legit_with_ring(u)),
               ("legit_ring_identity", "error", "users.ring_id", "SELECT count(*) AS n FROM users_b WHERE NOT is_abuse_account AND ring_id <> ''"))
_TYPES = ", ".join(f"'{t}'" for t in S.RING_TYPES)
findings_query(
    "val_11_ring_types", _lab(lambda u, t: D.ring_types(u)),
    ("ring_type_vocabulary", "error", "users.ring_type",
     f"SELECT count(DISTINCT ring_type) AS n FROM users_b WHERE is_abuse_account AND ring_type <> '' AND ring_type NOT IN ({_TYPES})"),
    ("ring_type_coverage", "error", "users.ring_type",
     f"SELECT count(*) AS n FROM (SELECT unnest([{_TYPES}]) AS t) WHERE t NOT IN (SELECT ring_type FROM users_b WHERE is_abuse_account)"))
findings_query("val_12_abuse_transaction_owner", _lab(D.abuse_transactions_of_others),
               ("abuse_transaction_owner", "error", "transactions.user_id", """SELECT count(*) AS n FROM txns_b t WHERE is_abuse_transaction
                 AND NOT EXISTS (SELECT 1 FROM users_b u WHERE u.user_id = t.user_id AND is_abuse_account)"""))
findings_query(
    "val_13_abuse_transaction_rings", _lab(D.abuse_transaction_rings),
    ("abuse_transaction_ring", "error", "transactions.ring_id", "SELECT count(*) AS n FROM txns_b WHERE is_abuse_transaction AND coalesce(ring_id, '') = ''"),
    ("ring_consistency", "error", "transactions.ring_id", """SELECT count(*) AS n FROM txns_b t JOIN users_b u USING (user_id)
       WHERE is_abuse_transaction AND t.ring_id <> '' AND t.ring_id <> u.ring_id"""))
findings_query(
    "val_14_estimated_values", _lab(lambda u, t: D.estimated_values(u)),
    ("negative_value", "error", "users.estimated_abuse_value", "SELECT count(*) AS n FROM users_b WHERE estimated_abuse_value < 0"),
    ("legit_value", "warning", "users.estimated_abuse_value", "SELECT count(*) AS n FROM users_b WHERE NOT is_abuse_account AND estimated_abuse_value > 0"))
findings_query("val_15_inactive_abusers", _lab(D.inactive_abusers),
               ("abuse_without_transactions", "info", "users.user_id", """SELECT count(*) AS n FROM users_b u WHERE is_abuse_account
                 AND NOT EXISTS (SELECT 1 FROM txns_b t WHERE t.user_id = u.user_id AND is_abuse_transaction)"""))
findings_query("val_16_empty_splits", _lab(lambda u, t: D.empty_splits(u)),
               ("split_nonempty", "error", "(s)", "SELECT s, 1 AS n FROM (SELECT unnest(['train', 'val', 'test']) AS s) WHERE s NOT IN (SELECT split FROM users_b)"))
_SPAN = "SELECT count(*) AS n FROM (SELECT {c} FROM users_b WHERE {w} {c} <> '' GROUP BY {c} HAVING count(DISTINCT split) > 1)"
findings_query("val_17_group_isolation", _lab(lambda u, t: D.group_isolation(u)),
               ("ring_isolation", "error", "users.ring_id", _SPAN.format(c="ring_id", w="is_abuse_account AND")),
               ("group_isolation", "error", "users.group_id", _SPAN.format(c="group_id", w="")))
add("val_18_split_fractions",
    lambda d: D.split_fractions(d.users).select("subject", "n", F.col("context")["achieved"].cast("double").alias("achieved")),
    "SELECT split AS subject, count(*) AS n, round(count(*) / (SELECT count(*) FROM users), 4) AS achieved FROM users GROUP BY split")
findings_query("val_19_splits_without_abuse", _lab(lambda u, t: D.splits_without_abuse(u)),
               ("split_has_abuse", "warning", "(s)", """SELECT s, 1 AS n FROM (SELECT unnest(['train', 'val', 'test']) AS s)
                 WHERE s NOT IN (SELECT split FROM users_b WHERE is_abuse_account)"""))

# --- Distributions ------------------------------------------------------------------

_LONG = " UNION ALL ".join(f"SELECT is_abuse_account AS abuse, '{c}' AS feature, {c}::DOUBLE AS value FROM account_features" for c in X.ACCOUNT_COLUMNS)
cte("account_long", _LONG)


def _overlap_sql(name: str, source: str, bins: str = "30") -> None:
    cte(f"{name}_range", f"""SELECT feature, min(value) AS lo, max(value) AS hi, count(*) FILTER (abuse) AS na, count(*) FILTER (NOT abuse) AS nl,
        any_value({bins}) AS bins FROM {source} WHERE value IS NOT NULL GROUP BY feature""")
    cte(f"{name}", f"""SELECT feature, CASE WHEN bool_or(na = 0 OR nl = 0 OR hi <= lo) THEN 1 ELSE sum(least(a / na, l / nl)) END AS overlap FROM (
        SELECT v.feature, CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / r.bins)), r.bins - 1) ELSE 0 END AS bin,
          any_value(na) AS na, any_value(nl) AS nl, any_value(hi) AS hi, any_value(lo) AS lo,
          count(*) FILTER (abuse) AS a, count(*) FILTER (NOT abuse) AS l FROM {source} v JOIN {name}_range r USING (feature)
        WHERE value IS NOT NULL GROUP BY v.feature, bin) GROUP BY feature""")


_overlap_sql("account_overlap", "account_long")
add("val_20_overlap", lambda d: X.overlap(X.account_values(B.account_features(d.users, d.transactions))).withColumn("overlap", F.round("overlap", 8)),
    "SELECT feature, round(overlap, 8) AS overlap FROM account_overlap")
add("val_21_class_summary", lambda d: X.class_summary(X.account_values(B.account_features(d.users, d.transactions))),
    """SELECT feature, abuse, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_pop(value), 4) AS std,
       round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.9), 4) AS p90, round(min(value), 4) AS min, round(max(value), 4) AS max
       FROM account_long GROUP BY feature, abuse""")
add("val_21_low_overlap", lambda d: X.distribution_checks(B.account_features(d.users, d.transactions)).select("check", "subject"),
    """SELECT 'single_feature_separability' AS "check", feature AS subject FROM account_overlap WHERE overlap < 0.3""")

cte("labelled", "SELECT t.*, coalesce(u.is_abuse_account, false) AS abuse FROM txns t LEFT JOIN users u USING (user_id)")
cte("categories", """SELECT feature, value, count(*) AS rows, count(*) FILTER (abuse) AS abuse_rows FROM (
  SELECT 'city' AS feature, city AS value, is_abuse_account AS abuse FROM users
  UNION ALL SELECT 'user_segment', user_segment, is_abuse_account FROM users UNION ALL SELECT 'age_group', age_group, is_abuse_account FROM users
  UNION ALL SELECT 'device_type', device_type, abuse FROM labelled LEFT JOIN devices USING (device_id)
  UNION ALL SELECT 'network_type', network_type, abuse FROM labelled LEFT JOIN ips USING (ip_id)
  UNION ALL SELECT 'transaction_status', transaction_status, abuse FROM labelled) WHERE value IS NOT NULL GROUP BY ALL""")
add("val_22_category_counts", lambda d: X.category_counts(d.users, d.transactions, d.devices, d.ips), "SELECT * FROM categories")
add("val_22_categorical_leakage",
    lambda d: X.categorical_leakage(X.category_counts(d.users, d.transactions, d.devices, d.ips), dominance=0.09)
    .select("feature", "value", "rows", F.round("abuse_share", 6).alias("abuse_share")),
    """SELECT feature, value, rows, round(abuse_rows / rows, 6) AS abuse_share FROM categories WHERE rows >= 20 AND abuse_rows / rows >= 0.09""")
_NAMES = "SELECT unnest([{}]) AS name"
_USER_NAMES = _NAMES.format(", ".join(f"'{c}'" for c in _USER_COLUMNS))
_FORBIDDEN = ", ".join(f"'{c}'" for c in S.FORBIDDEN_FEATURES)
add("val_23_whitelist_guard", lambda d: X.whitelist_guard(X.column_names(d.users)).select("check", "subject", "n"),
    f"""SELECT 'whitelist_guard' AS "check", name AS subject, (SELECT count(*) FROM users) AS n FROM ({_USER_NAMES}) WHERE name IN ({_FORBIDDEN})""")
cte("txn_long", """SELECT abuse, 'amount' AS feature, amount AS value, 30 AS bins FROM labelled
  UNION ALL SELECT abuse, 'hour', hour(ts)::DOUBLE, 24 FROM labelled""")
_overlap_sql("txn_overlap", "txn_long", "bins")
add("val_24_transaction_overlaps", lambda d: X.transaction_overlaps(d.users, d.transactions).withColumn("overlap", F.round("overlap", 8)),
    "SELECT feature, round(overlap, 8) AS overlap FROM txn_overlap")
_TOKENS = ", ".join(f"'{t}'" for t in S.SUSPICIOUS_TOKENS)
add("val_25_feature_name_audit", lambda d: X.feature_name_audit(X.column_names(d.users)).select("check", "subject", "n"),
    f"""SELECT "check", subject, (SELECT count(*) FROM users) AS n FROM (SELECT 'explicit_label' AS "check", name AS subject FROM ({_USER_NAMES}) WHERE name IN ({_FORBIDDEN})
       UNION ALL SELECT 'suspicious_name', name FROM ({_USER_NAMES}) WHERE name <> 'user_id'
         AND len(list_intersect(regexp_split_to_array(lower(name), '[_\\W]+'), [{_TOKENS}])) > 0)""")
add("val_24_account_separability",
    lambda d: X.low_overlap(X.overlap(X.account_values(B.account_features(d.users, d.transactions), X.SEPARABILITY_COLUMNS)), "leakage", "account_feature_separability")
    .select("check", "subject"),
    f"""SELECT 'account_feature_separability' AS "check", feature AS subject FROM account_overlap WHERE overlap < {X.OVERLAP_FLOOR}
       AND feature IN ({', '.join(f"'{c}'" for c in X.SEPARABILITY_COLUMNS)})""")
findings_query("val_25_missing_feature_table", lambda d: X.missing_splits(d.users.where("split <> 'val'")),
               ("feature_table_exists", "error", "(s)", """SELECT s, 1 AS n FROM (SELECT unnest(['train', 'val', 'test']) AS s)
                 WHERE s NOT IN (SELECT split FROM users WHERE split <> 'val')"""))
findings_query("val_25_label_is_binary",
               lambda d: X.label_is_binary(d.users.selectExpr("if(user_segment = 'student', 2, cast(is_abuse_account AS int)) AS label")),
               ("label_binary", "error", "label", "SELECT count(*) AS n FROM users WHERE user_segment = 'student'"))

# --- Graph checks -------------------------------------------------------------------


def _graph_pair(d):
    """The graph of the damaged transactions, checked against the clean tables."""
    rows = damaged(d)["transactions"]
    return G.build_edges(rows), rows


cte("edges_b", """
SELECT user_id AS src, device_id AS dst, 'uses_device' AS edge_type FROM txns_b WHERE device_id <> '' GROUP BY ALL
UNION ALL SELECT user_id, ip_id, 'connects_from' FROM txns_b WHERE ip_id <> '' GROUP BY ALL
UNION ALL SELECT user_id, address_id, 'associated_with' FROM txns_b WHERE address_id <> '' GROUP BY ALL
UNION ALL SELECT user_id, payment_instrument_id, 'uses_payment_instrument' FROM txns_b WHERE payment_instrument_id <> '' GROUP BY ALL""")
findings_query(
    "val_26_node_existence",
    lambda d: GC.node_existence((lambda e, r: G.build_nodes(e, r))(*_graph_pair(d)), d.tables),
    ("node_existence", "error", "('user')", "SELECT count(DISTINCT user_id) AS n FROM txns_b WHERE user_id NOT IN (SELECT user_id FROM users)"),
    ("node_existence", "error", "('promotion')",
     "SELECT count(DISTINCT promo_id) AS n FROM txns_b WHERE promo_id <> '' AND promo_id NOT IN (SELECT promo_id FROM promotions)"))
findings_query("val_27_self_loops",
               lambda d: GC.self_loops(G.build_edges(d.transactions).withColumn("dst", F.when(F.col("edge_type") == "at_merchant", F.col("src")).otherwise(F.col("dst")))),
               ("self_loops", "error", "edges", "SELECT count(*) AS n FROM txns WHERE merchant_id <> ''"))
findings_query(
    "val_28_edge_provenance", lambda d: GC.edge_provenance(_graph_pair(d)[0], d.transactions),
    ("edge_provenance", "error", "(edge_type)", """SELECT edge_type, count(*) AS n FROM edges_b b WHERE NOT EXISTS
       (SELECT 1 FROM entity_edges e WHERE e.src = b.src AND e.dst = b.dst AND e.edge_type = b.edge_type) GROUP BY edge_type"""),
    ("edge_provenance", "info", "edges", "SELECT count(*) AS n FROM edges_b"))
findings_query("val_29_label_independence", lambda d: GC.label_independence(d.tables),
               ("label_independence", "error", "edges", "SELECT 0 AS n"))


def _label_dependent(transactions):
    """A faulty builder: where labels are at hand, it leaves out what abuse transactions add."""
    rows = transactions.where("NOT is_abuse_transaction") if "is_abuse_transaction" in transactions.columns else transactions
    return G.user_entity_edges(rows)


cte("abuse_edges", """SELECT e.src, e.dst, e.edge_type, e.weight, count(t.transaction_id) AS abusive FROM entity_edges e LEFT JOIN txns t
  ON t.user_id = e.src AND t.is_abuse_transaction AND e.dst IN (t.device_id, t.ip_id, t.address_id, t.payment_instrument_id) GROUP BY ALL""")
findings_query("val_29_planted_dependency", lambda d: GC.label_independence(d.tables, _label_dependent),
               ("label_independence", "error", "edges", "SELECT sum(CASE WHEN abusive = 0 THEN 0 WHEN abusive = weight THEN 1 ELSE 2 END) AS n FROM abuse_edges"))
add("val_29_lost_edges", lambda d: (lambda edges: GC.changed_edges(edges, edges.where("NOT (edge_type = 'connects_from' AND dst LIKE '%_N')")))(
    G.user_entity_edges(d.transactions)), "SELECT src, dst, edge_type, weight, 1 AS surplus FROM entity_edges WHERE edge_type = 'connects_from' AND dst LIKE '%_N'")


def _isolation(d):
    graph = split_graph(d)
    moved = d.users.withColumn("split", F.expr("CASE WHEN cast(substr(user_id, 5) AS bigint) % 40 = 1 THEN 'test' ELSE split END"))
    return GC.split_isolation(graph, graph.nodes, moved)


cte("moved", "SELECT user_id, CASE WHEN substr(user_id, 5)::BIGINT % 40 = 1 THEN 'test' ELSE split END AS split FROM users")
findings_query(
    "val_30_split_isolation", _isolation,
    ("node_membership", "error", "nodes", "SELECT count(*) AS n FROM s_nodes JOIN moved USING (user_id) WHERE split <> view"),
    ("cross_split_edge", "error", "(view)", """SELECT view, count(*) AS n FROM s_edges JOIN moved x ON x.user_id = a JOIN moved y ON y.user_id = b
       WHERE x.split <> y.split GROUP BY view"""))
findings_query(
    "val_31_recency_bounds",
    lambda d: GC.recency_bounds(
        B.recency_features(d.transactions, B.decision_times(d.transactions)), d.transactions.where("transaction_status = 'success' AND amount > 400000")),
    *[("recency_exceeds_total", "error", f"recent_transaction_count_{w}d", f"""SELECT count(*) AS n FROM beh_recent
        JOIN (SELECT user_id, count(*) AS total FROM txns WHERE transaction_status = 'success' AND amount > 400000 GROUP BY user_id) USING (user_id)
        WHERE recent_transaction_count_{w}d > total""") for w in (1, 7, 30)])

def _all_findings(d):
    t = damaged(d)
    return D.combine([D.integrity(t, START, END), D.labels(t["users"], t["transactions"]), D.splits(t["users"])])


_MODULE_OF = {**{i: "integrity" for i in range(1, 9)}, **{i: "labels" for i in range(9, 16)}, **{i: "splits" for i in (16, 17, 19)}}
_EVERYTHING = " UNION ALL ".join(
    f"SELECT '{_MODULE_OF[int(name[4:6])]}' AS module, severity FROM ({union})"
    for name, union in _FINDING_SQL.items() if int(name[4:6]) in _MODULE_OF
)
_SUMMARY_SQL = f"""SELECT module, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
        count(*) FILTER (severity = 'error') = 0 AS ok FROM ({_EVERYTHING}) GROUP BY module"""
add("val_33_summary", lambda d: D.summarize(_all_findings(d)), _SUMMARY_SQL)
add("val_33_overall", lambda d: D.overall(_all_findings(d)),
    f"""SELECT count(*) FILTER (severity = 'error') AS total_errors, count(*) FILTER (severity = 'warning') AS total_warnings,
        count(*) FILTER (severity = 'error') = 0 AS ok FROM ({_EVERYTHING})""")


def _reported(d, part, schema):
    """What a report folder holds, read back."""
    folder = shared_folder(d.spark)
    validation.report(_all_findings(d), folder)
    return d.spark.read.schema(schema).json(f"{folder}/{part}")


add("snk_05_module_reports", lambda d: _reported(d, "modules", "module string, errors bigint, warnings bigint, ok boolean"), _SUMMARY_SQL)
add("snk_05_findings_of_modules", lambda d: _reported(d, "findings", "severity string, module string").where("severity <> 'info'").groupBy("module", "severity").agg(F.count(F.lit(1)).alias("findings")),
    f"SELECT module, severity, count(*) AS findings FROM ({_EVERYTHING}) WHERE severity <> 'info' GROUP BY ALL")


def _validated(d):
    return D.summarize(validation.validate_data(damaged(d), START, END))


add("val_33_all_modules", _validated)
