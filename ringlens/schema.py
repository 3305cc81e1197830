"""Table layouts and vocabularies shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: vocabularies -------------------------------------------------

USER_SEGMENTS = ("individual", "family_member", "student", "office_employee", "small_business_user")
AGE_GROUPS = ("18-25", "26-35", "36-45", "46-60", "60+")
DEVICE_TYPES = ("android", "ios", "web", "tablet")
NETWORK_TYPES = ("home", "mobile", "office", "college", "hostel", "public", "business")
ADDRESS_TYPES = ("residential", "apartment", "hostel", "office", "shared_accommodation")
INSTRUMENT_TYPES = ("card", "upi", "wallet")
MERCHANT_CATEGORIES = (
    "food", "electronics", "fashion", "travel", "gaming",
    "subscriptions", "groceries", "home", "education", "services",
)
TRANSACTION_STATUSES = ("success", "failed", "refunded")
RING_TYPES = (
    "direct_infrastructure", "promotion_coordination", "indirect_multihop", "distributed_behavioral",
)
SPLITS = ("train", "val", "test")
SPLIT_FRACTIONS = {"train": 0.70, "val": 0.15, "test": 0.15}

# --- Fixed values: label columns ------------------------------------------------

LABEL_FIELDS = (
    "is_abuse_account", "is_abuse_transaction", "ring_id", "ring_type", "estimated_abuse_value",
)
FORBIDDEN_FEATURES = LABEL_FIELDS + ("split",)
SUSPICIOUS_TOKENS = ("abuse", "fraud", "ring", "label", "bad", "malicious", "scam")

# --- Fixed values: the typed graph ----------------------------------------------

# entity kind -> (transaction column, edge type, node type, source table)
ENTITY_KINDS = {
    "device": ("device_id", "uses_device", "device", "devices"),
    "ip": ("ip_id", "connects_from", "ip", "ips"),
    "address": ("address_id", "associated_with", "address", "addresses"),
    "payment_instrument": (
        "payment_instrument_id", "uses_payment_instrument", "payment_instrument", "payment_instruments",
    ),
}
ENTITY_COLUMNS = tuple(v[0] for v in ENTITY_KINDS.values())
ENTITY_EDGE_TYPES = tuple(v[1] for v in ENTITY_KINDS.values())
TRANSACTION_EDGE, MERCHANT_EDGE, PROMOTION_EDGE = "makes_transaction", "at_merchant", "uses_promotion"
EDGE_TYPES = ENTITY_EDGE_TYPES + (TRANSACTION_EDGE, MERCHANT_EDGE, PROMOTION_EDGE)
NODE_SOURCES = {
    "user": ("users", "user_id"),
    "device": ("devices", "device_id"),
    "ip": ("ips", "ip_id"),
    "address": ("addresses", "address_id"),
    "payment_instrument": ("payment_instruments", "payment_instrument_id"),
    "transaction": ("transactions", "transaction_id"),
    "merchant": ("merchants", "merchant_id"),
    "promotion": ("promotions", "promo_id"),
}
GRAPH_TRANSACTION_COLUMNS = (
    "transaction_id", "user_id", "merchant_id", "payment_instrument_id",
    "device_id", "ip_id", "address_id", "promo_id",
)
SHARED_COUNTS = {
    "device": "shared_device_count",
    "ip": "shared_ip_count",
    "address": "shared_address_count",
    "payment_instrument": "shared_payment_instrument_count",
    "promotion": "shared_promotion_count",
}
RELATIONSHIP_LABELS = {
    "shared_device_count": "shared_device",
    "shared_ip_count": "shared_ip",
    "shared_address_count": "shared_address",
    "shared_payment_instrument_count": "shared_payment_instrument",
}

# --- Fixed values: feature names ------------------------------------------------

STATIC_FEATURES = (
    "transaction_count", "average_transaction_amount", "median_transaction_amount",
    "transaction_amount_std", "promo_usage_rate", "unique_merchant_count", "unique_promo_count",
    "unique_payment_instrument_count", "unique_device_count", "unique_ip_count",
    "unique_address_count", "account_age_days", "transaction_frequency",
    "failed_transaction_rate", "refund_rate", "weekend_activity_rate", "night_activity_rate",
)
RECENCY_FEATURES = (
    "recent_transaction_count_1d", "recent_transaction_count_7d", "recent_transaction_count_30d",
    "recent_amount_sum_30d", "days_since_first_device_seen", "recent_unique_entity_count_30d",
)
BASELINE_FEATURES = STATIC_FEATURES + RECENCY_FEATURES

FEATURE_GROUPS = {
    "direct": (
        "degree", "weighted_degree", "unique_devices", "unique_ips", "unique_addresses",
        "unique_payment_instruments", "unique_merchants", "unique_promotions",
    ),
    "shared_entity": (
        "number_of_accounts_sharing_devices", "number_of_accounts_sharing_ips",
        "number_of_accounts_sharing_addresses", "number_of_accounts_sharing_payment_instruments",
        "number_of_accounts_sharing_promotions",
    ),
    "neighbor": (
        "number_of_user_neighbors", "number_of_high_degree_neighbors",
        "average_neighbor_degree", "maximum_neighbor_degree",
    ),
    "two_hop": (
        "two_hop_user_count", "two_hop_unique_entity_count",
        "two_hop_shared_device_count", "two_hop_shared_ip_count",
    ),
    "centrality": ("degree_centrality", "clustering_coefficient", "betweenness_centrality"),
    "community": ("community_size", "community_density", "community_edge_count"),
}
GRAPH_FEATURES = tuple(name for group in FEATURE_GROUPS.values() for name in group)
MODEL_FEATURES = {"baseline": BASELINE_FEATURES, "graph": GRAPH_FEATURES + BASELINE_FEATURES}

ABLATIONS = {
    "baseline_only": (),
    "baseline_plus_direct": ("direct",),
    "baseline_plus_direct_shared": ("direct", "shared_entity"),
    "baseline_plus_neighbor_twohop": ("neighbor", "two_hop"),
    "baseline_plus_centrality_community": ("centrality", "community"),
    "baseline_plus_all_graph": (
        "direct", "shared_entity", "neighbor", "two_hop", "centrality", "community",
    ),
}

COUNTERFACTUAL_FEATURES = (
    "number_of_accounts_sharing_devices", "number_of_accounts_sharing_ips",
    "number_of_accounts_sharing_addresses", "number_of_accounts_sharing_payment_instruments",
    "promo_usage_rate", "clustering_coefficient", "transaction_frequency",
    "two_hop_user_count", "betweenness_centrality", "night_activity_rate",
)

# --- Fixed values: texts shown to investigators ---------------------------------

FEATURE_DESCRIPTIONS = {
    "degree": "Number of entities (devices, IPs, etc.) directly connected to this account",
    "weighted_degree": "Total transaction-weighted connections to entities",
    "unique_devices": "Number of distinct devices used for transactions",
    "unique_ips": "Number of distinct IP addresses used for transactions",
    "unique_addresses": "Number of distinct addresses associated with transactions",
    "unique_payment_instruments": "Number of distinct payment instruments used",
    "unique_merchants": "Number of distinct merchants transacted with",
    "unique_promotions": "Number of distinct promotions used",
    "number_of_accounts_sharing_devices": "Number of other accounts connected through shared devices",
    "number_of_accounts_sharing_ips": "Number of other accounts connected through shared IP addresses",
    "number_of_accounts_sharing_addresses": "Number of other accounts connected through shared addresses",
    "number_of_accounts_sharing_payment_instruments": "Number of other accounts sharing payment instruments",
    "number_of_accounts_sharing_promotions": "Number of other accounts sharing promotions",
    "number_of_user_neighbors": "Number of directly connected user accounts in the graph",
    "number_of_high_degree_neighbors": "Number of highly-connected neighbouring accounts",
    "average_neighbor_degree": "Average connectivity of neighbouring accounts",
    "maximum_neighbor_degree": "Maximum connectivity among neighbouring accounts",
    "two_hop_user_count": "Number of accounts reachable within two hops through shared entities",
    "two_hop_unique_entity_count": "Number of distinct shared entities across two-hop neighbours",
    "two_hop_shared_device_count": "Number of shared devices across two-hop neighbours",
    "two_hop_shared_ip_count": "Number of shared IP addresses across two-hop neighbours",
    "degree_centrality": "How central this account is in the user network (degree-based)",
    "clustering_coefficient": "How tightly clustered this account's neighbours are",
    "betweenness_centrality": "How often this account lies on shortest paths between others",
    "community_size": "Size of the graph community this account belongs to",
    "community_density": "Edge density within the account's graph community",
    "community_edge_count": "Number of edges within the account's graph community",
    "transaction_count": "Total number of transactions made",
    "average_transaction_amount": "Average transaction amount",
    "median_transaction_amount": "Median transaction amount",
    "transaction_amount_std": "Standard deviation of transaction amounts",
    "promo_usage_rate": "Fraction of transactions that used a promotion",
    "unique_merchant_count": "Number of distinct merchants transacted with (baseline)",
    "unique_promo_count": "Number of distinct promotions used (baseline)",
    "unique_payment_instrument_count": "Number of distinct payment instruments (baseline)",
    "unique_device_count": "Number of distinct devices used (baseline)",
    "unique_ip_count": "Number of distinct IP addresses used (baseline)",
    "unique_address_count": "Number of distinct addresses used (baseline)",
    "account_age_days": "Account age in days from creation to last activity",
    "transaction_frequency": "Transactions per day over the active period",
    "failed_transaction_rate": "Fraction of transactions that failed",
    "refund_rate": "Fraction of transactions that were refunded",
    "weekend_activity_rate": "Fraction of transactions on weekends",
    "night_activity_rate": "Fraction of transactions at night (22:00-06:00)",
    "recent_transaction_count_1d": "Number of transactions in the last 1 day",
    "recent_transaction_count_7d": "Number of transactions in the last 7 days",
    "recent_transaction_count_30d": "Number of transactions in the last 30 days",
    "recent_amount_sum_30d": "Total transaction amount in the last 30 days",
    "days_since_first_device_seen": "Days since the earliest device was first seen",
    "recent_unique_entity_count_30d": "Distinct entities used in the last 30 days",
}

# --- Fixed values: table layouts and primary keys ------------------------------------

_TABLE_DDL = {
    "users":
        "user_id STRING, account_created_at DATE, user_segment STRING, city STRING, age_group STRING, "
        "is_abuse_account BOOLEAN, ring_id STRING, ring_type STRING, group_id STRING, group_type STRING, "
        "estimated_abuse_value DOUBLE, split STRING",
    "transactions":
        "transaction_id STRING, user_id STRING, timestamp TIMESTAMP, amount DOUBLE, merchant_id STRING, "
        "payment_instrument_id STRING, device_id STRING, ip_id STRING, address_id STRING, promo_id STRING, "
        "transaction_status STRING, is_abuse_transaction BOOLEAN, ring_id STRING",
    "devices": "device_id STRING, device_type STRING, device_fingerprint_group STRING, first_seen_at DATE",
    "ips": "ip_id STRING, network_type STRING, city STRING, network_cluster STRING",
    "addresses": "address_id STRING, address_type STRING, city STRING, household_group STRING",
    "payment_instruments": "payment_instrument_id STRING, instrument_type STRING, issuer_group STRING",
    "promotions":
        "promo_id STRING, promo_type STRING, discount_value DOUBLE, discount_percentage DOUBLE, "
        "eligibility_type STRING, max_usage INT",
    "merchants": "merchant_id STRING, merchant_category STRING, city STRING",
}
PRIMARY_KEYS = {
    "users": "user_id", "devices": "device_id", "ips": "ip_id", "addresses": "address_id",
    "payment_instruments": "payment_instrument_id", "promotions": "promo_id",
    "merchants": "merchant_id", "transactions": "transaction_id",
}

_TYPES = {t.simpleString(): t for t in (T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.DateType())}


def _layout(ddl: str) -> T.StructType:
    """A DDL string as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind.lower()]) for name, kind in (column.split() for column in ddl.split(","))])


TABLES = {name: _layout(ddl) for name, ddl in _TABLE_DDL.items()}
