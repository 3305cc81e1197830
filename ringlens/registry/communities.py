from __future__ import annotations

from pyspark.sql import functions as F

from ringlens.operators import communities as C
from ringlens.operators import evidence as V
from ringlens.operators import explain as X
from ringlens.operators import projection as P
from ringlens.operators import risk as R
from ringlens.operators import summaries as M
from ringlens.operators import typed_graph as G
from ringlens.registry.base import REGISTRY, cte
from ringlens.registry.evidence import GRAPH_REASON_LINES, graph_evidence_counts
from ringlens.registry.graph import whole_graph
from ringlens.session import cut_lineage

add = REGISTRY.add


def _louvain(d):
    graph = whole_graph(d).stored()
    return graph, C.louvain(graph)


def detected(d):
    """The whole user graph, its communities and their features."""

    def build():
        graph, labels = _louvain(d)
        labels = cut_lineage(labels)
        return graph, labels, cut_lineage(C.community_features(labels, graph))

    return d.once("communities", build)


def _properties(d):
    """Errors against what holds for any right assignment: members, inner edges and numbers counted anew."""
    graph, labels, features = detected(d)
    table = features.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("community_size").alias("size"), F.max("community_edge_count").alias("edges"), F.max("community_density").alias("density"))
    ends = labels.selectExpr("user_id AS a", "raw AS ra"), labels.selectExpr("user_id AS b", "raw AS rb")
    inside = graph.edges.join(ends[0], "a").join(ends[1], "b").where("ra = rb").agg(F.count(F.lit(1)).alias("inside"))
    levels = C.modularity(graph, graph.nodes.selectExpr("view", "user_id", "user_id AS raw")).agg(F.min("modularity").alias("alone"))
    found = C.modularity(graph, labels).agg(F.min("modularity").alias("reached"))
    sums = table.agg(
        F.sum("n").alias("users"), F.count(F.lit(1)).alias("communities"), F.max("community_id").alias("last"), F.sum("edges").alias("edges"),
        F.expr("count_if(n <> size)").alias("sizes"),
        F.expr("count_if(size > 1 AND abs(density - 2 * edges / (cast(size AS double) * (size - 1))) > 1e-7)").alias("densities"))
    return graph.nodes.agg(F.count(F.lit(1)).alias("nodes")).select(F.struct("nodes").alias("g")).join(F.broadcast(sums), F.lit(True)).join(
        F.broadcast(inside), F.lit(True)).join(F.broadcast(levels), F.lit(True)).join(F.broadcast(found), F.lit(True)).selectExpr(
        "users", "sizes AS wrong_sizes", "densities AS wrong_densities", "edges - inside AS wrong_edges", "last + 1 - communities AS wrong_numbers",
        "g.nodes - users AS missing_users", "reached > alone AS better_than_single")  # every side is one row


add("com_01_communities", lambda d: detected(d)[1])
add("com_01_modularity", lambda d: C.modularity(*detected(d)[:2]))


def _disconnected(d):
    """Users, and communities that fall apart inside: counted from the components of their inner edges."""
    graph, labels, _ = detected(d)
    parts = C.connected_parts(graph, labels).select("view", "user_id", F.col("raw").alias("part"))
    per = labels.join(parts, ["view", "user_id"]).groupBy("view", "raw").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"))
    return per.agg(F.sum("n").alias("users"), F.expr("count_if(parts > 1)").alias("disconnected"))


add("com_01_connected", _disconnected, "SELECT count(*) AS users, 0 AS disconnected FROM g_nodes")
add("com_02_community_properties", _properties,
    """SELECT count(*) AS users, 0 AS wrong_sizes, 0 AS wrong_densities, 0 AS wrong_edges, 0 AS wrong_numbers, 0 AS missing_users,
       true AS better_than_single FROM g_nodes""")
add("com_03_detected_communities", lambda d: detected(d)[2].drop("view"))
add("com_05_detected_overview", lambda d: M.community_overview(M.community_table(detected(d)[2], d.users)))


def assigned(d):
    """A rule-based assignment (smallest id among a user and its neighbours) to check what follows from one."""
    graph = whole_graph(d).stored()
    labels = graph.nodes.join(P.lowest_neighbours(graph), ["view", "user_id"], "left").selectExpr("view", "user_id", "least(user_id, coalesce(low, user_id)) AS raw")
    labels = cut_lineage(labels)
    return graph, labels, C.community_features(labels, graph)


cte("numbered", """SELECT raw, count(*) AS community_size, row_number() OVER (ORDER BY count(*) DESC, min(user_id)) - 1 AS community_id
  FROM raw_assignment GROUP BY raw""")
cte("com", """SELECT user_id, community_id, community_size, coalesce(e, 0) AS community_edge_count,
  CASE WHEN community_size > 1 THEN round(2 * coalesce(e, 0) / (community_size * (community_size - 1)), 8) ELSE 0 END AS community_density
  FROM raw_assignment JOIN numbered USING (raw) LEFT JOIN (SELECT x.raw, count(*) AS e FROM g_edges JOIN raw_assignment x ON x.user_id = a
    JOIN raw_assignment y ON y.user_id = b WHERE x.raw = y.raw GROUP BY x.raw) USING (raw)""")
add("com_02_numbering", lambda d: assigned(d)[2].select("user_id", "community_id"), "SELECT user_id, community_id FROM com")
add("com_03_sizes_and_density", lambda d: assigned(d)[2].drop("view"), "SELECT * FROM com")
for _i, _c in ((25, "community_size"), (26, "community_density"), (27, "community_edge_count")):
    add(f"gf_{_i}_{_c}", lambda d, c=_c: assigned(d)[2].select("user_id", c), f"SELECT user_id, {_c} FROM com")
cte("com_table", """SELECT community_id, count(*) AS size, any_value(community_density) AS density, avg(is_abuse_account::INT) AS abuse_share
  FROM com JOIN users USING (user_id) GROUP BY community_id""")


def _table(d):
    return M.community_table(assigned(d)[2], d.users)


add("com_05_overview", lambda d: M.community_overview(_table(d)),
    """SELECT count(*) AS communities, min(size) AS min_size, max(size) AS max_size, round(avg(size), 3) AS mean_size,
       count(*) FILTER (size = 1) AS singletons, round(avg(density), 6) AS mean_density, median(size) AS median_size FROM com_table""")
add("com_05_largest", lambda d: M.largest_communities(_table(d)),
    """SELECT community_id, size, round(density, 6) AS density, round(abuse_share, 4) AS abuse_share FROM com_table ORDER BY size DESC, community_id LIMIT 10""")
add("sum_14_legitimate_communities", lambda d: M.legitimate_communities(_table(d), 5, 60, 0.2).select("community_id", "size"),
    "SELECT community_id, size FROM com_table WHERE size BETWEEN 5 AND 60 AND abuse_share < 0.2")
add("sum_14_mid_sized_legitimate_communities", lambda d: M.legitimate_communities(_table(d)).select("community_id", "size"),
    "SELECT community_id, size FROM com_table WHERE size BETWEEN 15 AND 60 AND abuse_share < 0.05")
add("inv_09_detected_context", lambda d: (lambda graph, _, features: V.community_context(features, graph.edges))(*detected(d)))
add("sum_11_community_sizes", lambda d: M.value_histogram(_table(d), "size"), "SELECT size AS value, count(*) AS rows FROM com_table GROUP BY 1")


def _context(d):
    graph, _, features = assigned(d)
    return V.community_context(features, graph.edges)


add("inv_09_community_context", _context,
    """SELECT user_id, community_id, community_size, community_density, coalesce(n, 0) AS user_degree, coalesce(n, 0) AS neighbor_count FROM com
       LEFT JOIN (SELECT u AS user_id, count(*) AS n FROM g_arcs GROUP BY u) USING (user_id)""")
add("inv_14_why_community", lambda d: X.why_community(_context(d)).select("user_id", "title", "strength"),
    "SELECT user_id, 'Community Context' AS title, 'INDIRECT' AS strength FROM com WHERE community_size > 1")


def _graph_reasons(d):
    edges = cut_lineage(G.user_entity_edges(d.transactions))
    graph, _, features = assigned(d)
    counts = graph_evidence_counts(d, edges, graph.edges, V.multi_hop_paths(edges), features.select("user_id", "community_density"))
    return counts.select("user_id", F.explode(R.reasons(counts)).alias("r")).select("user_id", "r.code", "r.description")


add("rsk_03_graph_reasons", _graph_reasons, " UNION ALL ".join(
    f"SELECT user_id, '{code}' AS code, {text} AS description FROM ({q})" for code, text, q in (
        *GRAPH_REASON_LINES, ("GRAPH_DENSE_COMMUNITY", "'User is in a highly dense community (density: ' || printf('%.2f', round_even(n, 2)) || ').'",
                              "SELECT user_id, community_density AS n FROM com WHERE community_density > 0.5"))))
