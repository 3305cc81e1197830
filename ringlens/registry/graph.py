from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import centrality as C
from ringlens.operators import components as CC
from ringlens.operators import graph_features as GF
from ringlens.operators import projection as P
from ringlens.operators import typed_graph as G
from ringlens.registry.base import REGISTRY, cte
from ringlens.session import cut_lineage

add = REGISTRY.add

# --- Typed graph ------------------------------------------------------------------

_UNPIVOT = " UNION ALL ".join(
    f"SELECT user_id AS src, {column} AS dst, '{edge}' AS edge_type, '{kind}' AS kind FROM txns"
    for kind, (column, edge, _, _) in S.ENTITY_KINDS.items()
)
cte("entity_edges", f"""
SELECT src, dst, edge_type, any_value(kind) AS kind, count(*) AS weight FROM ({_UNPIVOT})
WHERE dst IS NOT NULL AND dst <> '' GROUP BY src, dst, edge_type""")
cte("txn_edges", """
SELECT user_id AS src, transaction_id AS dst, 'makes_transaction' AS edge_type, 1 AS weight FROM txns
UNION ALL SELECT transaction_id, merchant_id, 'at_merchant', 1 FROM txns WHERE merchant_id IS NOT NULL AND merchant_id <> ''
UNION ALL SELECT transaction_id, promo_id, 'uses_promotion', 1 FROM txns WHERE promo_id IS NOT NULL AND promo_id <> ''""")
cte("all_edges", "SELECT src, dst, edge_type, weight FROM entity_edges UNION ALL SELECT * FROM txn_edges")
_NODE_TYPE = "CASE edge_type " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in G._TARGET_TYPES.items()) + " END"
cte("all_nodes", f"""SELECT DISTINCT dst AS id, {_NODE_TYPE} AS node_type FROM all_edges
UNION SELECT DISTINCT user_id, 'user' FROM txns""")

add("gr_01_user_entity_edges", lambda d: G.user_entity_edges(d.transactions), "SELECT src, dst, edge_type, weight FROM entity_edges")
for _name, _build, _type in (
    ("gr_02_transaction_edges", G.transaction_edges, S.TRANSACTION_EDGE),
    ("gr_03_merchant_edges", G.merchant_edges, S.MERCHANT_EDGE),
    ("gr_04_promotion_edges", G.promotion_edges, S.PROMOTION_EDGE),
):
    add(_name, lambda d, b=_build: b(d.transactions), f"SELECT * FROM txn_edges WHERE edge_type = '{_type}'")
add("gr_05_edges_without_transactions",
    lambda d: G.build_edges(d.transactions, include_transaction_nodes=False), "SELECT src, dst, edge_type, weight FROM entity_edges")
add("gr_06_nodes", lambda d: G.build_nodes(G.build_edges(d.transactions), d.transactions), "SELECT * FROM all_nodes")
add("gr_07_nodes_of_type",
    lambda d: G.nodes_of_type(G.build_nodes(G.build_edges(d.transactions), d.transactions), "device"),
    "SELECT * FROM all_nodes WHERE node_type = 'device' ORDER BY id")
add("gr_08_edges_of_type", lambda d: G.edges_of_type(G.build_edges(d.transactions), "connects_from"),
    "SELECT * FROM all_edges WHERE edge_type = 'connects_from'")
add("gr_09_split_graph", lambda d: G.build_edges(G.split_view(d.transactions, d.users, "test")),
    """SELECT e.* FROM all_edges e LEFT JOIN txns t ON t.transaction_id = e.src
       JOIN users u ON u.user_id = coalesce(t.user_id, e.src) WHERE u.split = 'test'""")
add("gr_10_allowed_columns", lambda d: G.graph_columns(d.transactions),
    f"SELECT {', '.join(S.GRAPH_TRANSACTION_COLUMNS)} FROM txns")

# --- Projection -------------------------------------------------------------------

LOW_CAP = 4


def whole_graph(d, hub_cap: int | None = None) -> P.UserGraph:
    return P.project_users(P.single_view(d.transactions), hub_cap=hub_cap)


def split_graph(d) -> P.UserGraph:
    users = d.users.select(F.col("split").alias("view"), "user_id")
    return P.project_users(P.split_views(d.transactions, d.users), users)


def _projection_sql(prefix: str, view: str, cap: int | None = None, members: str | None = None, used: str | None = None) -> None:
    """Steps ``<prefix>members/hubs/edges/nodes/arcs`` for one choice of view."""
    cte(f"{prefix}members", members or f"SELECT DISTINCT {view} AS view, kind, dst AS entity_id, src AS user_id FROM entity_edges JOIN users ON user_id = src")
    cte(f"{prefix}used", used or f"SELECT DISTINCT {view} AS view, user_id, promo_id FROM txns JOIN users USING (user_id) WHERE promo_id <> ''")
    cte(f"{prefix}hubs", f"SELECT view, kind AS attr, entity_id, count(*) AS n_users FROM {prefix}members GROUP BY ALL HAVING {'false' if cap is None else f'count(*) > {cap}'}")
    cte(f"{prefix}linking", f"""SELECT * FROM {prefix}members m WHERE NOT EXISTS (SELECT 1 FROM {prefix}hubs h
        WHERE h.view = m.view AND h.attr = m.kind AND h.entity_id = m.entity_id)""")
    counts = ", ".join(
        f"count(*) FILTER (l.kind = '{k}') AS {c}" for k, c in S.SHARED_COUNTS.items() if k != "promotion"
    )
    cte(f"{prefix}pairs", f"""SELECT l.view, l.user_id AS a, r.user_id AS b, {counts} FROM {prefix}linking l
        JOIN {prefix}linking r ON l.view = r.view AND l.kind = r.kind AND l.entity_id = r.entity_id AND l.user_id < r.user_id
        GROUP BY l.view, l.user_id, r.user_id""")
    cte(f"{prefix}promos", f"""SELECT view, a, b, count(*) AS shared_promotion_count FROM {prefix}pairs
        JOIN {prefix}used x USING (view) JOIN {prefix}used y USING (view)
        WHERE x.user_id = a AND y.user_id = b AND y.promo_id = x.promo_id GROUP BY view, a, b""")
    total = " + ".join(P.COUNTS)
    types = " + ".join(f"({c} > 0)::INT" for c in P.COUNTS)
    cte(f"{prefix}edges", f"""SELECT *, {total} AS weight, {types} AS shared_entity_types FROM (
        SELECT p.*, coalesce(s.shared_promotion_count, 0) AS shared_promotion_count FROM {prefix}pairs p LEFT JOIN {prefix}promos s USING (view, a, b))""")
    cte(f"{prefix}arcs", f"""SELECT view, a AS u, b AS v, * EXCLUDE (view, a, b) FROM {prefix}edges
        UNION ALL SELECT view, b, a, * EXCLUDE (view, a, b) FROM {prefix}edges""")


_projection_sql("g_", "'all'")
_projection_sql("low_", "'all'", LOW_CAP)
_projection_sql("s_", "split")
# Views that overlap: all transactions, and those from a day on.
SINCE = "1996-01-01"
_periods = f"SELECT 'all' AS view, * FROM txns UNION ALL SELECT 'since', * FROM txns WHERE ts >= DATE '{SINCE}'"
cte("period_txns", _periods)
_projection_sql("v_", "", members="SELECT DISTINCT view, kind, entity_id, user_id FROM (" + " UNION ALL ".join(
    f"SELECT view, user_id, {column} AS entity_id, '{kind}' AS kind FROM period_txns" for kind, (column, *_) in S.ENTITY_KINDS.items())
    + ") WHERE entity_id <> ''", used="SELECT DISTINCT view, user_id, promo_id FROM period_txns WHERE promo_id <> ''")


def overlapping_views(d):
    whole = P.single_view(d.transactions)
    return whole.unionByName(whole.where(F.col("timestamp") >= F.lit(SINCE).cast("timestamp")).withColumn("view", F.lit("since")))


cte("g_nodes", "SELECT DISTINCT 'all' AS view, user_id FROM txns")
cte("s_nodes", "SELECT split AS view, user_id FROM users")

EDGE_COLUMNS = "view, a, b, " + ", ".join(P.COUNTS) + ", weight, shared_entity_types"
add("prj_01_entity_users", lambda d: P.entity_users(P.single_view(d.transactions)), "SELECT view, kind, entity_id, user_id FROM g_members")
add("prj_02_skipped_hubs", lambda d: whole_graph(d, LOW_CAP).skipped_hubs, "SELECT * FROM low_hubs")
add("prj_02_edges_with_low_cap", lambda d: whole_graph(d, LOW_CAP).edges, f"SELECT {EDGE_COLUMNS} FROM low_edges")
add("prj_03_pair_counts", lambda d: whole_graph(d).edges.select("a", "b", *P.COUNTS[:4]),
    f"SELECT a, b, {', '.join(P.COUNTS[:4])} FROM g_edges")
add("prj_04_shared_promotions", lambda d: P.shared_promotions(whole_graph(d), P.single_view(d.transactions)), "SELECT * FROM g_promos")
add("prj_04_overlapping_views", lambda d: P.project_users(overlapping_views(d)).edges, f"SELECT {EDGE_COLUMNS} FROM v_edges")
add("prj_05_edge_weight", lambda d: whole_graph(d).edges.select("a", "b", "weight"), "SELECT a, b, weight FROM g_edges")
add("prj_06_shared_entity_types", lambda d: whole_graph(d).edges.select("a", "b", "shared_entity_types"),
    "SELECT a, b, shared_entity_types FROM g_edges")
add("prj_07_nodes_with_isolated", lambda d: split_graph(d).nodes, "SELECT * FROM s_nodes")
add("prj_all_split_edges", lambda d: split_graph(d).edges, f"SELECT {EDGE_COLUMNS} FROM s_edges")

# --- Graph features ---------------------------------------------------------------

cte("direct", """
SELECT t.user_id, coalesce(e.n, 0) + t.n AS degree, (coalesce(e.w, 0) + t.n)::BIGINT AS weighted_degree, coalesce(unique_devices, 0) AS unique_devices,
  coalesce(unique_ips, 0) AS unique_ips, coalesce(unique_addresses, 0) AS unique_addresses,
  coalesce(unique_payment_instruments, 0) AS unique_payment_instruments, unique_merchants, unique_promotions
FROM (SELECT user_id, count(*) AS n, count(DISTINCT nullif(merchant_id, '')) AS unique_merchants,
        count(DISTINCT nullif(promo_id, '')) AS unique_promotions FROM txns GROUP BY user_id) t
LEFT JOIN (SELECT src, count(*) AS n, sum(weight) AS w, count(*) FILTER (kind = 'device') AS unique_devices,
        count(*) FILTER (kind = 'ip') AS unique_ips, count(*) FILTER (kind = 'address') AS unique_addresses,
        count(*) FILTER (kind = 'payment_instrument') AS unique_payment_instruments FROM entity_edges GROUP BY src) e ON e.src = t.user_id""")


def _features_sql(p: str) -> None:
    cte(f"{p}totals", f"""SELECT view, u AS user_id, count(*) AS number_of_user_neighbors,
        sum(shared_device_count)::BIGINT AS number_of_accounts_sharing_devices, sum(shared_ip_count)::BIGINT AS number_of_accounts_sharing_ips,
        sum(shared_address_count)::BIGINT AS number_of_accounts_sharing_addresses,
        sum(shared_payment_instrument_count)::BIGINT AS number_of_accounts_sharing_payment_instruments,
        sum(shared_promotion_count)::BIGINT AS number_of_accounts_sharing_promotions, sum(weight)::BIGINT AS incident_total
        FROM {p}arcs GROUP BY view, u""")
    cte(f"{p}threshold", f"""SELECT view, greatest(floor(quantile_cont(coalesce(number_of_user_neighbors, 0), 0.9))::BIGINT, 2) AS threshold
        FROM {p}nodes LEFT JOIN {p}totals USING (view, user_id) GROUP BY view""")
    cte(f"{p}around", f"""SELECT {p}arcs.view, u AS user_id, count(*) FILTER (t.number_of_user_neighbors >= threshold) AS number_of_high_degree_neighbors,
        avg(t.number_of_user_neighbors) AS average_neighbor_degree, max(t.number_of_user_neighbors) AS maximum_neighbor_degree,
        sum(t.incident_total - weight)::BIGINT AS two_hop_unique_entity_count,
        sum(t.number_of_accounts_sharing_devices - shared_device_count)::BIGINT AS two_hop_shared_device_count,
        sum(t.number_of_accounts_sharing_ips - shared_ip_count)::BIGINT AS two_hop_shared_ip_count
        FROM {p}arcs JOIN {p}totals t ON t.view = {p}arcs.view AND t.user_id = v JOIN {p}threshold h ON h.view = t.view GROUP BY {p}arcs.view, u""")
    cte(f"{p}reach", f"""SELECT x.view, x.u AS user_id, count(DISTINCT y.v) AS two_hop_user_count FROM {p}arcs x
        JOIN {p}arcs y ON y.view = x.view AND y.u = x.v AND y.v <> x.u LEFT JOIN {p}arcs z ON z.view = x.view AND z.u = x.u AND z.v = y.v
        WHERE z.u IS NULL GROUP BY x.view, x.u""")
    cte(f"{p}triangles", f"""SELECT x.view, x.u AS user_id, count(*) AS triangles FROM {p}arcs x
        JOIN {p}arcs y ON y.view = x.view AND y.u = x.u AND y.v > x.v JOIN {p}arcs z ON z.view = x.view AND z.u = x.v AND z.v = y.v GROUP BY x.view, x.u""")
    wanted = S.FEATURE_GROUPS["shared_entity"] + S.FEATURE_GROUPS["neighbor"] + S.FEATURE_GROUPS["two_hop"]
    columns = ", ".join(
        f"round(coalesce({c}, 0), 8) AS {c}" if c == "average_neighbor_degree" else f"coalesce({c}, 0)::BIGINT AS {c}" for c in wanted
    )
    cte(f"{p}features", f"""SELECT view, user_id, {columns} FROM {p}nodes LEFT JOIN {p}totals USING (view, user_id)
        LEFT JOIN {p}around USING (view, user_id) LEFT JOIN {p}reach USING (view, user_id)""")
    cte(f"{p}degrees", f"""SELECT view, user_id, CASE WHEN n > 1 THEN round(coalesce(number_of_user_neighbors, 0) / (n - 1), 8) ELSE 0 END AS degree_centrality,
        CASE WHEN number_of_user_neighbors > 1 THEN round(2 * coalesce(triangles, 0) / (number_of_user_neighbors * (number_of_user_neighbors - 1)), 8)
          ELSE 0 END AS clustering_coefficient
        FROM {p}nodes JOIN (SELECT view, count(*) AS n FROM {p}nodes GROUP BY view) USING (view)
        LEFT JOIN {p}totals USING (view, user_id) LEFT JOIN {p}triangles USING (view, user_id)""")


_features_sql("g_")
_features_sql("s_")

for _i, _name in enumerate(S.FEATURE_GROUPS["direct"], start=1):
    add(f"gf_{_i:02d}_{_name}", lambda d, n=_name: GF.direct_features(d.transactions).select("user_id", n),
        f"SELECT user_id, {_name} FROM direct")


def _smooth(df):
    return df.withColumn("average_neighbor_degree", F.round("average_neighbor_degree", 8))


def _totals(d):
    graph = whole_graph(d).stored()
    return graph, P.both_directions(graph.across), GF.graph_totals(graph)


for _i, _name in enumerate(S.FEATURE_GROUPS["shared_entity"] + ("number_of_user_neighbors",), start=9):
    if _i <= 12:  # straight from the links of users and entities
        _build = lambda d, n=_name: GF.sharing_totals(P.entity_users(P.single_view(d.transactions))).select("user_id", n)
    else:
        _build = lambda d, n=_name: _totals(d)[2].select("user_id", n)
    add(f"gf_{_i:02d}_{_name}", _build, f"SELECT user_id, {_name} FROM g_totals")


def _threshold(d):
    graph, _, totals = _totals(d)
    return GF.high_degree_threshold(graph.nodes, totals)


def _around(d):
    graph, arcs, totals = _totals(d)
    return _smooth(GF.neighbour_features(arcs, totals, GF.high_degree_threshold(graph.nodes, totals), graph.homes))


add("gf_15_high_degree_threshold", _threshold, "SELECT * FROM g_threshold")
for _name, _column in (
    ("gf_15_high_degree_neighbors", "number_of_high_degree_neighbors"), ("gf_16_average_neighbor_degree", "average_neighbor_degree"),
    ("gf_17_maximum_neighbor_degree", "maximum_neighbor_degree"), ("gf_19_two_hop_unique_entity_count", "two_hop_unique_entity_count"),
    ("gf_20_two_hop_shared_device_count", "two_hop_shared_device_count"), ("gf_21_two_hop_shared_ip_count", "two_hop_shared_ip_count"),
):
    _sql = f"round({_column}, 8) AS {_column}" if _column == "average_neighbor_degree" else _column
    add(_name, lambda d, c=_column: _around(d).select("user_id", c), f"SELECT user_id, {_sql} FROM g_around")
add("gf_18_two_hop_user_count", lambda d: GF.graph_two_hop_users(whole_graph(d).stored()), "SELECT * FROM g_reach")
for _name, _column in (("gf_22_degree_centrality", "degree_centrality"), ("gf_23_clustering_coefficient", "clustering_coefficient")):
    add(_name, lambda d, c=_column: (lambda g, t: GF.degree_and_clustering(g, t).select("user_id", c))(*_totals(d)[::2]),
        f"SELECT user_id, {_column} FROM g_degrees")
add("gf_projection_features_per_split", lambda d: _smooth(GF.projection_features(split_graph(d).stored())), "SELECT * FROM s_features")
add("gf_23_clustering_per_split",
    lambda d: (lambda g: GF.degree_and_clustering(g, GF.graph_totals(g)))(split_graph(d).stored()), "SELECT * FROM s_degrees")

# Betweenness: breadth-first levels written out; at these scales no path is longer.
LEVELS, PIVOTS = 9, 250


def _betweenness_sql(p: str, cap: int) -> None:
    cte(f"{p}b0", f"""SELECT view, user_id AS s, user_id AS node, 1.0::DOUBLE AS paths FROM (SELECT *,
        row_number() OVER (PARTITION BY view ORDER BY md5(user_id || '|42'), user_id) AS r FROM {p}nodes) WHERE r <= {cap}""")
    for i in range(1, LEVELS + 1):
        near = f"SELECT view, s, node FROM {p}b{i - 1}" + (f" UNION ALL SELECT view, s, node FROM {p}b{i - 2}" if i > 1 else "")
        cte(f"{p}b{i}", f"""SELECT c.* FROM (SELECT f.view, s, v AS node, sum(paths) AS paths FROM {p}b{i - 1} f
            JOIN {p}arcs a ON a.view = f.view AND a.u = f.node GROUP BY f.view, s, v) c
            WHERE NOT EXISTS (SELECT 1 FROM ({near}) o WHERE o.view = c.view AND o.s = c.s AND o.node = c.node)""")
    cte(f"{p}d{LEVELS}", f"SELECT *, 0.0::DOUBLE AS dep FROM {p}b{LEVELS}")
    for i in range(LEVELS - 1, 0, -1):
        cte(f"{p}d{i}", f"""SELECT b.*, coalesce(b.paths * r.share, 0) AS dep FROM {p}b{i} b LEFT JOIN (
            SELECT f.view, s, v AS node, sum((1 + dep) / paths) AS share FROM {p}d{i + 1} f
            JOIN {p}arcs a ON a.view = f.view AND a.u = f.node GROUP BY f.view, s, v) r USING (view, s, node)""")
    union = " UNION ALL ".join(f"SELECT view, node, dep FROM {p}d{i}" for i in range(1, LEVELS + 1))
    cte(f"{p}betweenness", f"""SELECT view, user_id, CASE WHEN n > 2 THEN round(coalesce(dep, 0)
            * (n / least(n, {cap})::DOUBLE) / ((n - 1.0::DOUBLE) * (n - 2.0::DOUBLE)), 8) ELSE 0 END AS betweenness_centrality,
          true AS betweenness_approx
        FROM {p}nodes JOIN (SELECT view, count(*) AS n FROM {p}nodes GROUP BY view) USING (view)
        LEFT JOIN (SELECT view, node AS user_id, sum(dep) AS dep FROM ({union}) GROUP BY view, node) USING (view, user_id)""")


_betweenness_sql("s_", PIVOTS)
_betweenness_sql("g_", PIVOTS)
add("gf_24_betweenness_per_split", lambda d: (lambda g: C.betweenness(g, C.pivots(g.nodes, PIVOTS)))(split_graph(d).stored()),
    "SELECT * FROM s_betweenness")

# --- Components -------------------------------------------------------------------

cte("typed_arcs", "SELECT src AS u, dst AS v FROM all_edges UNION ALL SELECT dst, src FROM all_edges")
# Smallest labels spread over user-entity links, one user-to-user step per round; no component is wider than this.
ROUNDS = 14
cte("label0", "SELECT DISTINCT user_id AS id, user_id AS component FROM txns")
for _i in range(1, ROUNDS + 1):
    cte(f"spread{_i}", f"SELECT kind, entity_id, min(component) AS component FROM g_members JOIN label{_i - 1} ON id = user_id GROUP BY kind, entity_id")
    cte(f"label{_i}", f"""SELECT id, least(any_value(l.component), coalesce(min(s.component), any_value(l.component))) AS component FROM label{_i - 1} l
        LEFT JOIN g_members ON user_id = id LEFT JOIN spread{_i} s USING (kind, entity_id) GROUP BY id""")


def user_components(d):
    """Components of the whole projection. Every user of an entity is tied to the entity's smallest one, so a hub costs its size,
    no pair is formed and entities are no nodes."""
    transactions = P.single_view(d.transactions)
    links = cut_lineage(P.entity_users(transactions).where("user_id IS NOT NULL").select("kind", "entity_id", "user_id"))
    heads = links.groupBy("kind", "entity_id").agg(F.min("user_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    spokes = links.join(heads, ["kind", "entity_id"]).where("user_id <> head").selectExpr("user_id AS a", "head AS b").distinct()
    users = transactions.selectExpr("user_id AS id").where("id IS NOT NULL").distinct()
    return CC.connected_components(users, P.both_directions(spokes))


add("com_04_components", user_components, f"SELECT id, component FROM label{ROUNDS}")
add("com_04_component_summary", lambda d: CC.component_summary(user_components(d)),
    f"""SELECT count(*) AS components, max(size) AS largest_component FROM (SELECT count(*) AS size FROM label{ROUNDS} GROUP BY component)""")
