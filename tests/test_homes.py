"""A projection kept as homes and the edges across them, against pairs formed one by one."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ringlens.operators import communities as C
from ringlens.operators import evidence as V
from ringlens.operators import explain as X
from ringlens.operators import graph_features as GF
from ringlens.operators import projection as P


def sample(seed, users=40, promos=8):
    """Users with one of two large devices, small networks and promotions; some use both devices, some none."""
    chance = random.Random(seed)
    rows = []
    for _ in range(users * 4):
        user = f"U{chance.randrange(users):02}"
        big = chance.choice(["", "D" + str(int(user[1:]) % 2), "D" + str(int(user[1:]) % 2), chance.choice(["D0", "D1", "D7", "D8"])])
        rows.append((user, big, chance.choice(["", *[f"I{i}" for i in range(25)]]), chance.choice(["", *[f"P{i}" for i in range(promos)]])))
    return rows


def brute(rows):
    """Edges by pair: the counts of shared devices, networks and promotions."""
    held = {}
    for user, *things in rows:
        held.setdefault(user, [set(), set(), set()])
        for mine, x in zip(held[user], things):
            mine |= {x} - {""}
    edges = {}
    for a, b in combinations(sorted(held), 2):
        shared = [len(x & y) for x, y in zip(held[a], held[b])]
        if shared[0] + shared[1]:
            edges[a, b] = tuple(shared)
    return edges


@pytest.fixture
def graph(txns, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_USERS", 6)
    monkeypatch.setattr(P, "COMMON", 3)
    rows = sample(4)
    return P.project_users(P.single_view(txns(rows))).stored(), brute(rows)


def test_edges_of_homes_and_across_them(graph):
    graph, want = graph
    rows = graph.edges.collect()
    got = {(r.a, r.b): (r.shared_device_count, r.shared_ip_count, r.shared_promotion_count) for r in rows}
    assert got == want and len(rows) == len(want)
    assert all(r.weight == sum(want[r.a, r.b]) and r.shared_entity_types == sum(n > 0 for n in want[r.a, r.b]) for r in rows)
    assert 0 < graph.across.count() < len(want) / 2 and any(n[0] > 1 for n in want.values())


def test_sums_over_neighbours_need_no_pairs_at_home(graph):
    graph, _ = graph
    arcs, totals = P.both_directions(graph.edges), GF.graph_totals(graph)
    limits = GF.high_degree_threshold(graph.nodes, totals)
    plain = GF.neighbour_features(arcs, totals, limits)
    short = GF.neighbour_features(P.both_directions(graph.across), totals, limits, graph.homes).select(*plain.columns)
    exact = [F.round(c, 9).alias(c) if c.startswith("average") else F.col(c) for c in plain.columns]
    assert sorted(map(tuple, short.select(exact).collect())) == sorted(map(tuple, plain.select(exact).collect()))
    lows = {r.user_id: r.low for r in P.lowest_neighbours(graph).collect()}
    assert lows == {r.u: r.low for r in arcs.groupBy("u").agg(F.min("v").alias("low")).collect()}


def test_totals_and_two_hop_users_form_no_pair_at_home(graph, monkeypatch):
    graph, edges = graph
    arcs = P.both_directions(graph.edges)
    plain = GF.node_totals(arcs)
    two_hops = {r.user_id: r.two_hop_user_count for r in GF.two_hop_users(arcs).collect()}
    monkeypatch.setattr(P, "_home_arcs", None)
    graph.__dict__.pop("edges", None)
    totals = GF.graph_totals(graph)
    assert totals.columns == plain.columns and sorted(map(tuple, totals.collect())) == sorted(map(tuple, plain.collect()))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {u: len(set().union(*(near[v] for v in vs)) - vs - {u}) for u, vs in near.items()}
    got = {r.user_id: r.two_hop_user_count for r in GF.home_two_hop_users(graph.across, graph.homes, totals).collect()}
    assert got == {u: n for u, n in want.items() if n} == two_hops and len(got) > 5
    assert GF.projection_features(graph).count() == graph.nodes.count()


def test_triangles_and_inner_edges_from_homes(graph):
    graph, edges = graph
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {u: sum(w in near[v] for v, w in combinations(sorted(vs), 2)) for u, vs in near.items()}
    got = {r.user_id: r.triangles for r in GF.home_triangles(graph.across, graph.homes).collect()}
    assert got == {u: n for u, n in want.items() if n}
    labels = graph.nodes.withColumn("raw", F.expr("concat('R', cast(substring(user_id, 2) AS int) % 3)"))
    rows = {int(r.user_id[1:]) % 3: r.community_edge_count for r in C.community_features(labels, graph).collect()}
    assert rows == {k: sum(int(a[1:]) % 3 == k == int(b[1:]) % 3 for a, b in edges) for k in range(3)}


def test_arcs_of_some_users(graph):
    graph, edges = graph
    some = graph.nodes.where("user_id IN ('U01', 'U02', 'U09')").select("user_id")
    found = V.related_accounts(graph, some)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, V.related_accounts(graph.edges, some).collect()))
    assert {(r.user_id, r.related_id) for r in found.collect()} == {(u, v) for e in edges for u, v in (e, e[::-1]) if u in ("U01", "U02", "U09")}


def test_no_pair_at_home_is_shuffled(txns):
    """Eighty users of one device have 3,160 pairs; only those that share more are stored."""
    rows = [(f"U{i:02}", "D1", f"I{i // 2}", "P1") for i in range(80)]
    graph = P.project_users(P.single_view(txns(rows)))
    assert graph.parts[1].count() == 40 and graph.homes.count() == 80 and graph.edges.count() == 80 * 79 // 2


def test_assigned_communities_form_no_pair_of_the_whole_graph(graph, monkeypatch):
    """Smallest neighbours and inner edges come from the links; pairs are formed only inside a community."""
    graph, edges = graph
    monkeypatch.setattr(type(graph), "parts", property(lambda self: pytest.fail("pairs of the whole graph")))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    lows = {r.user_id: r.low for r in P.lowest_neighbours(graph).collect()}
    assert lows == {u: min(vs) for u, vs in near.items()}
    raw = {u: min(u, lows.get(u, u)) for u in (r.user_id for r in graph.nodes.collect())}
    labels = graph.nodes.sparkSession.createDataFrame([("all", *row) for row in raw.items()], "view string, user_id string, raw string")
    got = {r.user_id: r.community_edge_count for r in C.community_features(labels, graph).collect()}
    assert got == {u: sum(raw[a] == c == raw[b] for a, b in edges) for u, c in raw.items()} and max(got.values()) > 5


def test_arcs_of_some_users_pair_only_their_entities(graph, monkeypatch):
    graph, edges = graph
    monkeypatch.setattr(type(graph), "across", property(lambda self: pytest.fail("pairs of the whole graph")))
    fresh = P.ProjectedGraph(lambda: graph.links, lambda links: built.append(P._homes_and_light(links, None)) or built[-1], graph.nodes, None)
    built = []
    some = graph.nodes.where("user_id IN ('U01', 'U02')").select("user_id")
    rows = fresh.arcs_of(some).collect()
    assert sorted((r.u, r.v) for r in rows) == sorted((u, v) for e in edges for u, v in (e, e[::-1]) if u in ("U01", "U02"))
    assert all((r.shared_device_count, r.shared_ip_count) == edges[min(r.u, r.v), max(r.u, r.v)][:2] for r in rows)
    assert len(built) == 1 and "parts" not in fresh.__dict__ and built[0][1].count() < graph.parts[1].count()


def test_accounts_by_kind_list_no_pair_at_home(graph, spark, monkeypatch):
    graph, _ = graph
    held = graph.nodes.selectExpr("user_id", "explode(array('device', 'ip', 'address')) AS node_type")
    plain = X.why_links(held, V.related_accounts(graph.edges)).collect()
    monkeypatch.setattr(P, "_home_arcs", None)
    graph.__dict__.pop("edges", None)
    assert sorted(X.why_links(held, graph).collect()) == sorted(plain)


def test_related_lists_shuffle_no_pair_at_home(graph, monkeypatch):
    """Pairs at home are formed behind the last exchange, and ranks are those of all edges."""
    graph, _ = graph
    monkeypatch.setattr(P, "PLACE_PAIRS", 100)  # several places a home
    plain = V.related_lists(V.related_accounts(graph.edges))
    monkeypatch.setattr(P, "_home_arcs", None)
    graph.__dict__.pop("edges", None)
    short = V.related_lists(V.related_accounts(graph))
    assert short.columns == plain.columns and sorted(map(tuple, short.collect())) == sorted(map(tuple, plain.collect()))
    plan = short._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = plan[plan.index("Window"):plan.index("Generate explode(concat")]
    assert "row_number" in above and "Exchange" not in above


def test_links_go_through_one_exchange(spark):
    """A constant view is folded away; the windows by entity must not exchange the rows again for it."""
    uses = spark.createDataFrame([("device", "D1", f"U{i}") for i in range(9)] * 2, "kind string, entity_id string, user_id string")
    links = P.shared_links(uses.withColumn("view", F.lit(P.WHOLE)))
    assert links.count() == 9 and {r.low for r in links.collect()} == {"U0", "U1"}
    assert links._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_links_number_their_entities(graph):
    """One number per entity, whatever the view and kind; homes go by it instead of the id."""
    graph, _ = graph
    rows = graph.links.select("view", "kind", "entity_id", "entity").distinct().collect()
    assert len({r.entity for r in rows}) == len({r[:3] for r in rows}) == len(rows) > 10
    assert graph.homes.schema["home"].dataType.simpleString() == "struct<kind:string,entity:bigint>"


def test_transactions_are_read_once(txns, monkeypatch):
    """Links, promotions and nodes of a stored projection come from one stored copy."""
    stored = []
    monkeypatch.setattr(P, "cut_lineage", lambda df, plain=P.cut_lineage: stored.append(df) or plain(df))
    source = P.single_view(txns(sample(4)))
    graph = P.project_users(source).stored()
    assert graph.edges.count() and graph.nodes.count()
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves().head().getClass().getName()
    assert sum(df._jdf.queryExecution().optimizedPlan().collectLeaves().head().getClass().getName() == leaves for df in stored) == 1
