from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import components as CC
from ringlens.operators import projection as P
from ringlens.operators import summaries as M
from ringlens.operators import typed_graph as G
from ringlens.registry.base import REGISTRY, cte
from ringlens.registry.graph import whole_graph
from ringlens.sources.star import read_star

add = REGISTRY.add
_TABLE_SQL = {"transactions": "txns"}
add("sum_01_table_counts", lambda d: M.table_counts(d.tables),
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {_TABLE_SQL.get(t, t)}" for t in S.TABLES))
add("sum_01_label_rates", lambda d: M.label_rates(d.users, d.transactions),
    """SELECT 'accounts' AS entity, count(*) AS total, count(*) FILTER (is_abuse_account) AS abuse, round(avg(is_abuse_account::INT), 4) AS rate FROM users
       UNION ALL SELECT 'transactions', count(*), count(*) FILTER (is_abuse_transaction), round(avg(is_abuse_transaction::INT), 4) FROM txns""")
cte("rings", """SELECT ring_id, count(*) AS size, min(ring_type) AS ring_type, sum(estimated_abuse_value) AS value FROM users
  WHERE is_abuse_account GROUP BY ring_id""")
add("sum_02_ring_stats", lambda d: M.ring_stats(d.users),
    """SELECT count(*) AS rings, min(size) AS min_size, max(size) AS max_size, round(avg(size), 2) AS mean_size, median(size) AS median_size,
       (SELECT round(sum(estimated_abuse_value), 2) FROM users) AS total_value FROM rings""")
add("sum_03_amount_stats", lambda d: M.amount_stats(d.transactions),
    """SELECT round(avg(amount), 2) AS mean, round(median(amount), 2) AS median, round(quantile_cont(amount, 0.9), 2) AS p90,
       round(quantile_cont(amount, 0.99), 2) AS p99, round(max(amount), 2) AS max FROM txns""")
add("sum_04_promotion_usage", lambda d: M.promotion_usage(d.transactions),
    """SELECT count(*) FILTER (promo_id <> '') AS transactions_with_promo, round(avg((coalesce(promo_id, '') <> '')::INT), 4) AS promo_usage_rate,
       count(DISTINCT nullif(promo_id, '')) AS distinct_promos_used FROM txns""")
cte("per_entity", " UNION ALL ".join(
    f"SELECT '{k}' AS kind, {c} AS entity_id, count(DISTINCT user_id) AS users FROM txns WHERE {c} IS NOT NULL GROUP BY {c}"
    for k, c in (("device", "device_id"), ("ip", "ip_id"), ("address", "address_id"))))
add("sum_05_shared_infrastructure", lambda d: M.shared_infrastructure(d.transactions),
    "SELECT kind, max(users) AS max_users, count(*) FILTER (users > 1) AS shared_by_several FROM per_entity GROUP BY kind")
add("sum_06_status_breakdown", lambda d: M.breakdown(d.transactions, "transaction_status"),
    "SELECT transaction_status AS value, count(*) AS rows FROM txns GROUP BY 1")
add("sum_06_split_breakdown", lambda d: M.breakdown(d.users, "split"), "SELECT split AS value, count(*) AS rows FROM users GROUP BY 1")


def _graph(d):
    edges = G.build_edges(d.transactions)
    return edges, G.build_nodes(edges, d.transactions)


add("sum_07_graph_size", lambda d: M.graph_size(*_graph(d)),
    """SELECT total_nodes, total_edges, round(2 * total_edges / (total_nodes::DOUBLE * (total_nodes - 1)), 8) AS density
       FROM (SELECT count(*) AS total_nodes FROM all_nodes), (SELECT count(*) AS total_edges FROM all_edges)""")
add("sum_07_node_type_counts", lambda d: M.node_type_counts(_graph(d)[1]), "SELECT node_type, count(*) AS nodes FROM all_nodes GROUP BY 1")
add("sum_07_edge_type_counts", lambda d: M.edge_type_counts(_graph(d)[0]), "SELECT edge_type, count(*) AS edges FROM all_edges GROUP BY 1")
add("sum_07_user_degree", lambda d: M.user_degree_stats(*_graph(d)),
    """SELECT round(avg(n), 4) AS average_user_degree, max(n) AS maximum_user_degree, median(n) AS median_user_degree FROM (
       SELECT user_id, count(src) AS n FROM (SELECT DISTINCT user_id FROM txns) LEFT JOIN all_edges ON src = user_id GROUP BY user_id)""")


def _typed_components(d):
    edges, nodes = _graph(d)
    arcs = P.both_directions(edges.selectExpr("src AS a", "dst AS b"))
    return CC.component_summary(CC.connected_components(nodes.select("id"), arcs))


# Users linked through one value belong together; merchants and promotions link everybody who has one.
cte("linked", """SELECT user_id, 'a' || device_id AS x FROM txns UNION SELECT user_id, 'b' || ip_id FROM txns UNION SELECT user_id, 'c' || address_id FROM txns
  UNION SELECT user_id, 'd' || payment_instrument_id FROM txns UNION SELECT user_id, 'e' || merchant_id FROM txns
  UNION SELECT user_id, 'f' || promo_id FROM txns WHERE promo_id <> ''""")
cte("first_of", "SELECT x, min(user_id) AS head FROM linked WHERE x IS NOT NULL GROUP BY x")
cte("spokes", "SELECT DISTINCT user_id AS u, head AS v FROM linked JOIN first_of USING (x) WHERE user_id <> head")
cte("spoke_arcs", "SELECT u, v FROM spokes UNION SELECT v, u FROM spokes")
cte("flood", """SELECT user_id AS id, user_id AS reached FROM (SELECT DISTINCT user_id FROM txns)
  UNION SELECT f.id, s.v FROM flood f JOIN spoke_arcs s ON s.u = f.reached""")
cte("flood_component", "SELECT id AS user_id, min(reached) AS component FROM flood GROUP BY id")
add("sum_07_typed_components", _typed_components,
    """SELECT count(DISTINCT component) AS components, max(size) AS largest_component FROM (SELECT component, count(DISTINCT node) AS size FROM (
         SELECT component, user_id AS node FROM flood_component
         UNION ALL SELECT component, 't' || transaction_id FROM txns JOIN flood_component USING (user_id)
         UNION ALL SELECT component, x FROM linked JOIN flood_component USING (user_id) WHERE x IS NOT NULL) GROUP BY component)""")
add("sum_08_ring_losses", lambda d: M.ring_losses(d.users, d.transactions),
    """SELECT ring_id, size, round(coalesce(loss, 0), 2) AS loss, round(coalesce(loss, 0) / size, 2) AS value_per_member FROM rings
       LEFT JOIN (SELECT ring_id, sum(amount) AS loss FROM txns WHERE is_abuse_transaction AND transaction_status <> 'failed' GROUP BY 1) USING (ring_id)""")
add("sum_09_daily_volume", lambda d: M.daily_volume(d.transactions).withColumn("day", F.col("day").cast("string")),
    """SELECT strftime(day, '%Y-%m-%d') AS day, count(t.ts) AS rows FROM (SELECT unnest(generate_series(
       (SELECT min(ts)::DATE FROM txns)::TIMESTAMP, (SELECT max(ts)::DATE FROM txns)::TIMESTAMP, INTERVAL 1 DAY)) AS day)
       LEFT JOIN txns t ON t.ts::DATE = day::DATE GROUP BY 1""")
add("sum_09_daily_events",
    lambda d: M.daily_volume(read_star(d.spark, d.folder, "events"), "ts").withColumn("day", F.col("day").cast("string")),
    """SELECT strftime(day, '%Y-%m-%d') AS day, count(e.ts) AS rows FROM (SELECT unnest(generate_series(
       (SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS day)
       LEFT JOIN events e ON e.ts::DATE = day::DATE GROUP BY 1""")
add("sum_10_clipped_histogram", lambda d: M.clipped_histogram(d.transactions, "amount"),
    """SELECT least(floor((least(amount, hi) - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin, count(*) AS rows FROM txns,
       (SELECT quantile_cont(amount, 0.99) AS hi, min(amount) AS lo FROM txns) GROUP BY 1""")
add("sum_11_transactions_per_user", lambda d: M.value_histogram(M.transactions_per_user(d.transactions), "n"),
    "SELECT n AS value, count(*) AS rows FROM (SELECT count(*) AS n FROM txns GROUP BY user_id) GROUP BY 1")
add("sum_11_ring_sizes", lambda d: M.value_histogram(M.ring_sizes(d.users), "size"), "SELECT size AS value, count(*) AS rows FROM rings GROUP BY 1")
add("sum_11_users_per_entity",
    lambda d: M.users_per_entity(d.transactions).groupBy("kind", F.col("users").alias("value")).agg(F.count(F.lit(1)).alias("rows")),
    "SELECT kind, users AS value, count(*) AS rows FROM per_entity GROUP BY 1, 2")
add("sum_11_degrees",
    lambda d: M.value_histogram(P.both_directions(whole_graph(d).edges).groupBy("u").agg(F.count(F.lit(1)).alias("n")), "n"),
    "SELECT n AS value, count(*) AS rows FROM (SELECT count(*) AS n FROM g_arcs GROUP BY u) GROUP BY 1")
add("sum_12_top_promotions", lambda d: M.top_promotions(d.transactions),
    "SELECT promo_id, count(*) AS rows FROM txns WHERE promo_id <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
add("sum_13_rings_per_type", lambda d: M.rings_per_type(d.users),
    "SELECT t AS ring_type, count(ring_id) AS rings FROM (SELECT unnest([" + ", ".join(f"'{t}'" for t in S.RING_TYPES) + "]) AS t) LEFT JOIN rings ON ring_type = t GROUP BY 1")
cte("ring_edges", """SELECT x.ring_id, a, b FROM g_edges JOIN users x ON x.user_id = a JOIN users y ON y.user_id = b
  WHERE x.is_abuse_account AND y.is_abuse_account AND x.ring_id = y.ring_id AND x.ring_id <> ''""")
add("sum_15_ring_edges", lambda d: M.ring_subgraph(M.ring_graph(d.transactions, d.users), d.users), "SELECT * FROM ring_edges")


def _ring_components(d):
    """Components inside each ring: the same algorithm, on links that never leave a ring. A user is tied to the smallest other one of each entity."""
    graph = M.ring_graph(d.transactions, d.users)
    members = d.users.where("is_abuse_account AND ring_id <> ''").select("user_id", "ring_id")
    parts = CC.connected_components(members.selectExpr("user_id AS id"), P.both_directions(graph.links.selectExpr("user_id AS a", "low AS b").distinct()))
    counted = parts.withColumnRenamed("id", "user_id").join(members, "user_id").groupBy("ring_id").agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("component").alias("components"))
    return counted.join(M.ring_edge_counts(graph, d.users), "ring_id", "left").na.fill(0, ["edges"])


cte("ring_arcs", "SELECT a AS u, b AS v FROM ring_edges UNION ALL SELECT b, a FROM ring_edges")
cte("ring_walk", """SELECT user_id AS id, user_id AS reached FROM users WHERE is_abuse_account
  UNION SELECT w.id, r.v FROM ring_walk w JOIN ring_arcs r ON r.u = w.reached""")
add("sum_15_ring_components", _ring_components,
    """SELECT ring_id, count(*) AS members, count(DISTINCT component) AS components,
       (SELECT count(*) FROM ring_edges e WHERE e.ring_id = o.ring_id) AS edges
       FROM (SELECT id, min(reached) AS component FROM ring_walk GROUP BY id) JOIN users o ON o.user_id = id GROUP BY ring_id""")
