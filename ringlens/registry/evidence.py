from __future__ import annotations

from pyspark.sql import functions as F

from ringlens import schema as S
from ringlens.operators import behaviour as B
from ringlens.operators import evidence as V
from ringlens.operators import explain as X
from ringlens.operators import projection as P
from ringlens.operators import risk as R
from ringlens.operators import typed_graph as G
from ringlens.registry.base import REGISTRY, cte
from ringlens.registry.evaluation import T
from ringlens.registry.graph import whole_graph
from ringlens.session import cut_lineage

add = REGISTRY.add


def _edges(d):
    return G.user_entity_edges(d.transactions)


cte("ent", "SELECT src AS user_id, kind AS node_type, dst AS entity_id, weight FROM entity_edges")
for _i, _kind in enumerate(S.ENTITY_KINDS, start=1):
    add(f"inv_{_i:02d}_{_kind}_lists",
        lambda d, k=_kind: V.entity_lists(V.entities(_edges(d)).where(F.col("node_type") == k)),
        f"""SELECT user_id, node_type, row_number() OVER (PARTITION BY user_id ORDER BY entity_id) AS rank, entity_id
            FROM ent WHERE node_type = '{_kind}'""")
add("inv_04_shared_only", lambda d: V.entities(_edges(d), shared_only=True),
    "SELECT * FROM ent WHERE (node_type, entity_id) IN (SELECT (node_type, entity_id) FROM ent GROUP BY ALL HAVING count(*) > 1)")
_TYPES = ", ".join(f"CASE WHEN {c} > 0 THEN '{label}' END" for c, label in S.RELATIONSHIP_LABELS.items())
_TOTAL = " + ".join(S.RELATIONSHIP_LABELS)
cte("related", f"""SELECT u AS user_id, v AS related_id, list_filter([{_TYPES}], lambda x: x IS NOT NULL) AS types, {_TOTAL} AS shared_entity_count FROM g_arcs""")


def _flat(related):
    return related.withColumn("relationship_types", F.array_join("relationship_types", ","))


add("inv_05_related_accounts", lambda d: _flat(V.related_accounts(whole_graph(d).edges)),
    "SELECT user_id, related_id, array_to_string(types, ',') AS relationship_types, shared_entity_count FROM related")
add("inv_05_ranked_related", lambda d: V.strongest_related(whole_graph(d), 20).select("user_id", "related_id", "rank"),
    """SELECT user_id, related_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY shared_entity_count DESC, related_id) AS rank
       FROM related) WHERE rank <= 20""")
add("inv_05_related_lists",
    lambda d: _flat(V.related_lists(V.related_accounts(whole_graph(d)))),
    """SELECT user_id, related_id, array_to_string(types, ',') AS relationship_types, shared_entity_count,
       row_number() OVER (PARTITION BY user_id ORDER BY shared_entity_count DESC, related_id) AS rank FROM related""")

# Paths: every candidate, written out without the limits of the distributed plan.


def _paths_sql(p: str, source: str) -> None:
    cte(f"{p}all", f"""SELECT a.user_id, b.user_id AS fin, a.entity_id, a.node_type, b.weight FROM {source} a
        JOIN {source} b ON a.node_type = b.node_type AND a.entity_id = b.entity_id AND a.user_id <> b.user_id""")
    cte(f"{p}one", f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, entity_id, fin) AS position,
        [user_id, entity_id, fin] AS nodes, weight::DOUBLE AS strength, fin FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, fin ORDER BY weight DESC, entity_id) AS r FROM {p}all) WHERE r = 1""")
    cte(f"{p}k1", f"SELECT * FROM {p}one WHERE position <= 10")
    for hop in (2, 3):
        before = " UNION ALL ".join(f"SELECT user_id, fin FROM {p}k{h}" for h in range(1, hop))
        cte(f"{p}s{hop}", f"SELECT user_id, count(*) AS kept, list(fin) AS seen FROM ({before}) GROUP BY user_id HAVING count(*) < 10")
        cte(f"{p}c{hop}", f"""SELECT f.user_id, f.position AS parent, f.nodes, least(f.strength, n.weight::DOUBLE) AS strength, n.entity_id, n.fin, s.kept
            FROM {p}k{hop - 1} f JOIN {p}s{hop} s ON s.user_id = f.user_id
            JOIN {p}all n ON n.user_id = f.fin AND n.fin <> f.user_id AND NOT list_contains(s.seen, n.fin)""")
        cte(f"{p}k{hop}", f"""SELECT user_id, (kept + r)::INT AS position, list_concat(nodes, [entity_id, fin]) AS nodes, strength, fin FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY parent, entity_id, fin) AS r FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id, fin ORDER BY parent, entity_id) AS q FROM {p}c{hop}) WHERE q = 1) WHERE r <= 10 - kept""")


_paths_sql("pa_", "ent")
# Few users lack ten one-hop paths in the full graph; two kinds of links leave room for longer ones.
cte("ent_sparse", "SELECT * FROM ent WHERE node_type IN ('address', 'payment_instrument')")
_paths_sql("ps_", "ent_sparse")


def _paths(d, edges=None, hops=V.MAX_HOPS):
    return V.multi_hop_paths(cut_lineage(edges if edges is not None else _edges(d)), max_hops=hops)


def _path_rows(d, hop, sparse):
    edges = _edges(d).where("edge_type IN ('associated_with', 'uses_payment_instrument')") if sparse else None
    return _paths(d, edges, hop).where(F.col("hop_count") == hop).select(
        "user_id", "position", F.array_join("nodes", ">").alias("nodes"), "path_strength")


for _hop in (1, 2, 3):
    for _sparse, _p in ((False, "pa_"), (True, "ps_")):
        add(f"inv_{5 + _hop:02d}_paths_{_hop}_hop{'_sparse' if _sparse else ''}", lambda d, h=_hop, s=_sparse: _path_rows(d, h, s),
            f"SELECT user_id, position, array_to_string(nodes, '>') AS nodes, strength AS path_strength FROM {_p}k{_hop}")

cte("raw_assignment", """SELECT user_id, least(user_id, coalesce(m, user_id)) AS raw FROM g_nodes
  LEFT JOIN (SELECT u AS user_id, min(v) AS m FROM g_arcs GROUP BY u) USING (user_id)""")
add("inv_11_batch_evidence",
    lambda d: V.only_listed(V.entities(_edges(d)), d.users.where("ring_id = 'RING_3'"), limit=None),  # a whole ring, whatever its size
    "SELECT * FROM ent WHERE user_id IN (SELECT user_id FROM users WHERE ring_id = 'RING_3')")


def _linked(d):
    """The stored user-entity edges and the user graph of transactions read once."""
    d.keep("transactions", S.GRAPH_TRANSACTION_COLUMNS)
    return cut_lineage(_edges(d)), whole_graph(d)


def _subjects(d):
    return d.users.where("is_abuse_account").select("user_id")


cte("subjects", "SELECT user_id FROM users WHERE is_abuse_account")
_REL = "CASE node_type " + " ".join(
    f"WHEN '{k}' THEN '{label}'" for k, label in zip(S.ENTITY_KINDS, S.RELATIONSHIP_LABELS.values())) + " END"
cte("top40", """SELECT user_id, related_id, types FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY shared_entity_count DESC, related_id) AS r FROM related JOIN subjects USING (user_id)) WHERE r <= 40""")
cte("ego", f"""
SELECT user_id AS subject, user_id AS source, entity_id AS target, 'subject_entity' AS kind, rel AS relationship FROM (
  SELECT *, {_REL} AS rel, row_number() OVER (PARTITION BY user_id, node_type ORDER BY entity_id) AS r FROM ent JOIN subjects USING (user_id)) WHERE r <= 40
UNION SELECT user_id, unnest([user_id, entity_id]), unnest([entity_id, related_id]), unnest(['subject_entity', 'related_entity']), rel FROM (
  SELECT k.user_id, k.related_id, m.entity_id, rel, row_number() OVER (PARTITION BY k.user_id, k.related_id, rel ORDER BY m.entity_id) AS q
  FROM (SELECT user_id, related_id, unnest(types) AS rel FROM top40) k
  JOIN (SELECT *, {_REL} AS mr FROM ent) m ON m.user_id = k.user_id AND m.mr = rel
  JOIN ent t ON t.user_id = k.related_id AND t.node_type = m.node_type AND t.entity_id = m.entity_id) WHERE q <= 3""")
add("inv_12_ego_network", lambda d: V.ego_network(*_linked(d), _subjects(d)), "SELECT * FROM ego")
add("inv_12_ego_hidden", lambda d: V.ego_hidden_counts(*_linked(d), _subjects(d), max_entities=5, max_related=20),
    """SELECT s.user_id, coalesce(h, 0)::BIGINT AS hidden_entities, greatest(coalesce(r, 0) - 20, 0) AS hidden_related FROM subjects s
       LEFT JOIN (SELECT user_id, sum(greatest(n - 5, 0)) AS h FROM (SELECT user_id, node_type, count(*) AS n FROM ent GROUP BY ALL) GROUP BY user_id) USING (user_id)
       LEFT JOIN (SELECT user_id, count(*) AS r FROM related GROUP BY user_id) USING (user_id)""")


def _pairs(d):
    """Every labelled user to one fixed user."""
    return _subjects(d).selectExpr("user_id AS source", "'USR_0' AS target")


# Distances from one user, level by level, then the smallest path forwards.
cte("ua", "SELECT src AS u, dst AS v FROM entity_edges UNION ALL SELECT dst, src FROM entity_edges")
cte("to0", """SELECT 'USR_0' AS node, 0 AS dist UNION SELECT ua.v, dist + 1 FROM to0 JOIN ua ON ua.u = node WHERE dist < 6""")
cte("dist0", "SELECT node, min(dist) AS dist FROM to0 GROUP BY node")
cte("trail", """SELECT user_id AS source, user_id AS pos, dist AS rest, [user_id] AS path FROM subjects JOIN dist0 ON node = user_id
  UNION ALL SELECT source, v, d.dist, list_concat(path, [v]) FROM trail JOIN ua ON ua.u = pos JOIN dist0 d ON d.node = v AND d.dist = rest - 1""")
add("inv_13_shortest_paths",
    lambda d: V.shortest_paths(P.both_directions(_edges(d).selectExpr("src AS a", "dst AS b")), _pairs(d)).select(
        "source", "target", F.array_join("path", ">").alias("path"), "length"),
    "SELECT source, 'USR_0' AS target, array_to_string(min(path), '>') AS path, len(min(path)) - 1 AS length FROM trail WHERE pos = 'USR_0' GROUP BY source")


def _why(d):
    edges, graph = _linked(d)
    return X.why_links(V.entities(edges), graph)


_LINES = " UNION ALL ".join(f"""SELECT user_id, {i} AS rank, '{title}' AS title, '{strength}' AS strength, CASE WHEN a > 0
  THEN a || ' account' || (CASE WHEN a = 1 THEN '' ELSE 's' END) || ' share ' || e || ' {noun}' || (CASE WHEN e = 1 THEN '' ELSE 's' END) || ' with this subject.'
  ELSE e || ' {noun}' || (CASE WHEN e = 1 THEN '' ELSE 's' END) || ' linked to this subject; no related account shares them in the loaded evidence.' END AS detail
  FROM (SELECT user_id, count(*) AS e, coalesce(any_value(a), 0) AS a FROM ent LEFT JOIN (SELECT user_id, count(*) AS a FROM related WHERE list_contains(types, '{rel}') GROUP BY 1)
  USING (user_id) WHERE node_type = '{node}' GROUP BY user_id)""" for i, (rel, node, title, noun, strength) in enumerate(X._LINK_LINES, start=1))
add("inv_14_why_links", _why, _LINES)

# --- Explanation --------------------------------------------------------------------

cte("shown", "SELECT user_id, " + ", ".join(f"round(round(coalesce({c}, 0)::DOUBLE, 10)::DECIMAL(38, 10), 4)::DOUBLE AS {c}" for c in S.BASELINE_FEATURES) + " FROM behaviour")


def _features(d):
    return B.behavioural_features(d.users, d.transactions, d.devices)


def _share(column):
    return f"printf('%.0f', round_even({column} * 100, 0)) || '%"


cte("statements", f"""SELECT user_id, list_filter([
  CASE WHEN transaction_frequency > 2 THEN 'High transaction frequency (' || printf('%.1f', round_even(transaction_frequency, 1)) || ' per day).'
       WHEN transaction_frequency > 0.5 THEN 'Moderate transaction frequency (' || printf('%.1f', round_even(transaction_frequency, 1)) || ' per day).' END,
  CASE WHEN promo_usage_rate > 0.5 THEN 'High promotion usage rate (' || {_share('promo_usage_rate')} of transactions).'
       WHEN promo_usage_rate > 0.1 THEN 'Moderate promotion usage rate (' || {_share('promo_usage_rate')} of transactions).' END,
  CASE WHEN average_transaction_amount > 0 THEN 'Average transaction amount: ₹' || format('{{:,}}', round_even(average_transaction_amount, 0)::BIGINT) || '.' END,
  CASE WHEN transaction_count > 0 THEN 'Total transactions: ' || transaction_count::BIGINT || '.' END,
  CASE WHEN unique_merchant_count <= 2 AND transaction_count > 5 THEN 'Low merchant diversity relative to transaction count.'
       WHEN unique_merchant_count > 10 THEN 'High merchant diversity (' || unique_merchant_count::BIGINT || ' unique merchants).' END,
  CASE WHEN failed_transaction_rate > 0.1 THEN 'Elevated failed transaction rate (' || {_share('failed_transaction_rate')}).' END,
  CASE WHEN night_activity_rate > 0.3 THEN 'Significant night-time activity (' || {_share('night_activity_rate')} of transactions).' END,
  CASE WHEN weekend_activity_rate > 0.5 THEN 'Predominantly weekend activity (' || {_share('weekend_activity_rate')} of transactions).' END,
  CASE WHEN recent_transaction_count_7d > 10 THEN 'High recent activity (' || recent_transaction_count_7d::BIGINT || ' transactions in last 7 days).' END,
  CASE WHEN account_age_days < 7 THEN 'Very new account (' || printf('%.0f', round_even(account_age_days, 0)) || ' days old).' END], lambda x: x IS NOT NULL) AS said FROM shown""")
add("ex_07_statements", lambda d: X.behavioural_summary(_features(d)).select("user_id", F.array_join("statements", "|").alias("said")),
    "SELECT user_id, CASE WHEN len(said) = 0 THEN 'No notable behavioural patterns detected.' ELSE array_to_string(said, '|') END AS said FROM statements")
add("ex_07_feature_values", lambda d: X.behavioural_summary(_features(d)).select("user_id", F.explode("feature_values").alias("feature", "value")),
    " UNION ALL ".join(f"SELECT user_id, '{c}' AS feature, {c} AS value FROM shown" for c in S.BASELINE_FEATURES))


def _bad_evidence(d):
    rows = V.entities(_edges(d)).select("user_id", F.expr("if(node_type = 'ip', concat(entity_id, '_x'), entity_id) AS entity_id"))
    return X.audit_evidence_edges(rows, G.build_edges(d.transactions))


add("ex_08_audit_evidence_edges", _bad_evidence, "SELECT user_id, entity_id || '_x' AS entity_id FROM ent WHERE node_type = 'ip'")
add("ex_08_audit_path_edges", lambda d: (lambda e: X.audit_path_edges(_paths(d, e), e))(_edges(d)), "SELECT '' AS user_id, '' AS a, '' AS b WHERE false")
_prev = ""
for _i, (_reason, _cond, _order, _n) in enumerate(X._TARGETS):
    _not = f"AND user_id NOT IN ({_prev})" if _prev else ""
    cte(f"target{_i}", f"SELECT user_id, '{_reason}' AS selection_reason, prob FROM scored WHERE {_cond.replace('{t}D', str(T))} {_not} ORDER BY {_order}, user_id LIMIT {_n}")
    _prev = (_prev + " UNION ALL " if _prev else "") + f"SELECT user_id FROM target{_i}"
add("ex_09_select_targets", lambda d: X.select_targets(d.scored, T), " UNION ALL ".join(f"SELECT * FROM target{i}" for i in range(len(X._TARGETS))))

# --- Reasons -------------------------------------------------------------------------

_BEHAVIOUR_CODES = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond, _ in R._BEHAVIOUR_REASONS)
add("rsk_03_behaviour_reasons",
    lambda d: (lambda f: f.select("user_id", F.expr("array_join(transform(r, x -> x.code), ',') AS codes")))(
        (lambda f: f.select("user_id", R.reasons(f).alias("r")))(_features(d))),
    f"SELECT user_id, array_to_string(list_filter([{_BEHAVIOUR_CODES}], lambda x: x IS NOT NULL), ',') AS codes FROM shown")


def graph_evidence_counts(d, edges, graph_edges, paths, density=None):
    held = V.entities(edges).groupBy("user_id").agg(*[
        F.expr(f"count_if(node_type = '{k}') AS {c}") for k, c in zip(S.ENTITY_KINDS, R.GRAPH_INPUTS)])
    related = V.related_accounts(graph_edges).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_related"))
    hops = paths.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_paths"))
    table = d.users.select("user_id")
    for part in (held, related, hops):
        table = table.join(part, "user_id", "left")
    table = table.na.fill(0)
    return table.withColumn("community_density", F.lit(0.0)) if density is None else table.join(density, "user_id", "left")


_COUNT = "SELECT user_id, count(*) AS n FROM {src} {w} GROUP BY user_id"
GRAPH_REASON_LINES = (
    ("GRAPH_SHARED_DEVICE", "'User shares ' || n || ' device(s).'", _COUNT.format(src="ent", w="WHERE node_type = 'device'")),
    ("GRAPH_SHARED_IP", "'User shares ' || n || ' IP address(es).'", _COUNT.format(src="ent", w="WHERE node_type = 'ip'")),
    ("GRAPH_SHARED_ADDRESS", "'User shares ' || n || ' physical address(es).'", _COUNT.format(src="ent", w="WHERE node_type = 'address'")),
    ("GRAPH_SHARED_PAYMENT", "'User shares ' || n || ' payment instrument(s).'", _COUNT.format(src="ent", w="WHERE node_type = 'payment_instrument'")),
    ("GRAPH_CONNECTED_ACCOUNTS", "'User is directly connected to ' || n || ' other account(s) via shared entities.'", _COUNT.format(src="related", w="")),
    ("GRAPH_MULTI_HOP", "'User is part of ' || n || ' multi-hop path(s) spanning across the network.'",
     _COUNT.format(src="(SELECT user_id FROM pa_k1 UNION ALL SELECT user_id FROM pa_k2 UNION ALL SELECT user_id FROM pa_k3)", w="")),
)
