import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ringlens.operators import behaviour, centrality, components, graph_features, projection, typed_graph
from ringlens.operators import evidence as V
from ringlens.operators.projection import both_directions


def project(df, **kw):
    return projection.project_users(projection.single_view(df), **kw)


def test_shared_device_gives_one_edge(txns):
    graph = project(txns([("U1", "D1", "", ""), ("U2", "D1", "", ""), ("U3", "D2", "", "")]))
    edges = graph.edges.collect()
    assert [(e.a, e.b, e.shared_device_count, e.weight, e.shared_entity_types) for e in edges] == [("U1", "U2", 1, 1, 1)]
    assert {r.user_id for r in graph.nodes.collect()} == {"U1", "U2", "U3"}


def test_promotion_annotates_but_never_links(txns):
    graph = project(txns([("U1", "D1", "", "P1"), ("U2", "D1", "", "P1"), ("U1", "D1", "", ""), ("U2", "D1", "", ""), ("U3", "D9", "", "P1")]))
    edges = graph.edges.collect()
    assert [(e.a, e.b, e.shared_promotion_count, e.weight) for e in edges] == [("U1", "U2", 1, 2)]


def test_nothing_is_dropped_without_a_cap(txns, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK_USERS", 10)
    graph = project(txns([(f"U{i:03}", "D1", "", "") for i in range(160)]))
    assert graph.edges.count() == 160 * 159 // 2 and graph.skipped_hubs.isEmpty()


def test_views_that_overlap_do_not_mix(txns):
    rows = projection.single_view(txns([("U1", "D1", "", "P1"), ("U2", "D1", "", "P1")]))
    both = rows.unionByName(rows.withColumn("view", F.lit("jan")))
    got = {(e.view, e.shared_promotion_count, e.weight) for e in projection.project_users(both).edges.collect()}
    assert got == {("all", 1, 2), ("jan", 1, 2)}
    direct = graph_features.direct_features(both).collect()
    assert {(r.view, r.user_id, r.degree) for r in direct} == {(v, u, 2) for v in ("all", "jan") for u in ("U1", "U2")}


def test_hub_is_skipped_and_reported(txns):
    graph = project(txns([(f"U{i}", "D1", "", "") for i in range(4)]), hub_cap=3)
    assert graph.edges.count() == 0
    assert [(h.attr, h.entity_id, h.n_users) for h in graph.skipped_hubs.collect()] == [("device", "D1", 4)]


def test_edges_do_not_depend_on_labels(txns):
    df = txns([("U1", "D1", "I1", "P1"), ("U2", "D1", "", "")])
    bare = df.drop("is_abuse_transaction", "ring_id")
    assert typed_graph.build_edges(df).exceptAll(typed_graph.build_edges(bare)).isEmpty()


def test_two_hop_users_match_brute_force(user_graph, spark):
    chance = random.Random(6)
    pairs = [("h", f"n{i}") for i in range(8)] + [("n0", "x"), ("x", "y"), ("n1", "n2"), ("h2", "n3"), ("h2", "n4"), ("h2", "z"), ("h", "h2")]
    pairs += sorted({tuple(sorted(chance.sample([f"m{i:03}" for i in range(150)], 2))) for _ in range(260)})
    nodes = sorted({n for p in pairs for n in p})
    near = {n: {b if a == n else a for a, b in pairs if n in (a, b)} for n in nodes}
    want = {n: len(set().union(*(near[v] for v in near[n])) - near[n] - {n}) for n in nodes}
    arcs = both_directions(user_graph(pairs, nodes).edges)
    twice = arcs.unionByName(arcs.withColumn("view", F.lit("other")))
    rows = graph_features.two_hop_users(twice.repartition(5)).collect()
    for view in ("all", "other"):
        got = {r.user_id: r.two_hop_user_count for r in rows if r.view == view}
        assert {n: got.get(n, 0) for n in nodes} == want
    assert graph_features.two_hop_users(arcs.where("false")).count() == 0


def test_sharing_sums_need_no_pairs(txns):
    """The sums from links are those from the edges, and their plan joins links with entities only."""
    chance = random.Random(2)
    rows = [(f"U{chance.randrange(30):02}", chance.choice(["", *"ABCDE"]), chance.choice(["", *"vwxyz"]), "") for _ in range(120)]
    df = projection.single_view(txns(rows))
    found = graph_features.sharing_totals(projection.entity_users(df))
    names = [c for c in found.columns if c.startswith("number")]
    totals = graph_features.node_totals(both_directions(projection.project_users(df).edges))
    assert sorted(map(tuple, found.select("user_id", *names).collect())) == sorted(map(tuple, totals.select("user_id", *names).collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_triangles_and_clustering(user_graph):
    pairs = list(combinations("abcd", 2)) + [("d", "e"), ("e", "f")]
    graph = user_graph(pairs, "abcdefz")
    got = {r.user_id: r.triangles for r in graph_features.triangles(graph.edges).collect()}
    assert got == {"a": 3, "b": 3, "c": 3, "d": 3}
    totals = graph_features.node_totals(both_directions(graph.edges))
    rows = {r.user_id: r for r in graph_features.degree_and_clustering(graph, totals).collect()}
    assert rows["a"].clustering_coefficient == 1.0 and rows["d"].clustering_coefficient == 0.5
    assert rows["z"].degree_centrality == 0.0 and rows["d"].degree_centrality == round(4 / 6, 8)


def values(graph, **kw):
    return {r.user_id: r.betweenness_centrality for r in centrality.betweenness(graph, **kw).collect()}


def test_betweenness_of_known_shapes(user_graph):
    path = values(user_graph([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "abcde"))
    assert path == {"a": 0.0, "b": 0.5, "c": round(4 / 6, 8), "d": 0.5, "e": 0.0}
    star = values(user_graph([("c", x) for x in "1234"], "c1234"))
    assert star["c"] == 1.0 and star["1"] == 0.0
    assert set(values(user_graph(list(combinations("abcd", 2)), "abcd")).values()) == {0.0}


def test_betweenness_counts_isolated_nodes_and_pivots(user_graph):
    graph = user_graph([("a", "b"), ("b", "c")], "abcz")
    assert values(graph)["b"] == round(2 / 6, 8)
    exact = centrality.betweenness(graph).collect()
    assert values(graph, sources=centrality.pivots(graph.nodes, 4)) == values(graph) and not any(r.betweenness_approx for r in exact)
    sampled = centrality.betweenness(graph, centrality.pivots(graph.nodes, 2)).collect()
    assert all(r.betweenness_approx for r in sampled) and len(sampled) == 4


def test_components_of_a_long_chain(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y")]
    arcs = both_directions(spark.createDataFrame(chain, "a string, b string"))
    nodes = spark.createDataFrame([(n,) for n in sorted({n for c in chain for n in c} | {"solo"})], "id string")
    labels = components.connected_components(nodes, arcs)
    sizes = {r.component: r["size"] for r in components.component_sizes(labels).collect()}
    assert sizes == {"n000": 61, "x": 2, "solo": 1}


def test_contraction_rewrites_fewer_rows_each_round(spark):
    """A long chain in the order of its names, a hub, and random links: rows fall by the round, labels are those of a plain search."""
    chance = random.Random(9)
    pairs = [(f"c{i:04}", f"c{i + 1:04}") for i in range(600)] + [("hub", f"h{i:03}") for i in range(200)]
    pairs += [(f"r{chance.randrange(300):03}", f"r{chance.randrange(300):03}") for _ in range(180)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        front = [start] if start not in want else []
        while front:
            node = front.pop()
            if node not in want:
                want[node] = start
                front += near[node]
    arcs = both_directions(spark.createDataFrame(pairs, "a string, b string")).repartition(3)
    nodes = spark.createDataFrame([(n,) for n in [*near, "alone"]], "id string")
    assert {r.id: r.component for r in components.connected_components(nodes, arcs).collect()} == {**want, "alone": "alone"}
    numbers = {n: i for i, n in enumerate(sorted(near))}
    live, sizes = spark.createDataFrame([(numbers[r.u], numbers[r.v]) for r in arcs.where("u <> v").distinct().collect()], "u bigint, v bigint"), []
    while not live.isEmpty():
        step, left = components.contract(live, len(sizes))
        sizes.append((step.count(), live.count()))
        live = left
    assert all(b[0] < 0.8 * a[0] and b[1] < a[1] for a, b in zip(sizes, sizes[1:])) and len(sizes) < 12
    assert components.connected_components(nodes, arcs.where("false")).count() == len(near) + 1


def test_components_when_two_ids_hash_alike(spark, monkeypatch):
    """The first hash knows three numbers only; another one is taken."""
    salts = []

    def poor(ids, salt):
        salts.append(salt)
        return F.pmod(F.xxhash64(ids), F.lit(3)) if salt == 0 else F.xxhash64(ids, F.lit(salt))

    monkeypatch.setattr(components, "hashed", poor)
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "id string")
    arcs = both_directions(spark.createDataFrame([("c", "b"), ("d", "e"), ("b", "a")], "a string, b string"))
    assert {r.id: r.component for r in components.connected_components(nodes, arcs).collect()} == dict(zip("abcdefg", "aaaddfg"))
    assert max(salts) == 1


def test_user_components_tie_users_to_the_smallest_of_an_entity(spark, txns, monkeypatch):
    """No node but users, and one arc a user and entity: a device of thirty users gives 29 pairs."""
    from types import SimpleNamespace

    from ringlens.registry import graph as G

    seen = {}

    def search(nodes, arcs):
        seen["nodes"], seen["arcs"] = nodes.count(), arcs.count()
        return components_found(nodes, arcs)

    components_found = components.connected_components
    monkeypatch.setattr(G.CC, "connected_components", search)
    rows = [(f"U{i:02}", "D1", f"I{i}", "") for i in range(30)] + [("V1", "D2", "I3", ""), ("V2", "D2", "", ""), ("W", "", "", ""), (None, "D1", "", "")]
    found = G.user_components(SimpleNamespace(transactions=txns(rows))).collect()
    assert {r.id: r.component for r in found} == {**{f"U{i:02}": "U00" for i in range(30)}, "V1": "U00", "V2": "U00", "W": "W"}
    assert len(found) == 33 and seen == {"nodes": 33, "arcs": 2 * 31}


def test_users_without_transactions_get_zero_features(spark, txns):
    df = txns([("U1", "D1", "I1", "P1"), ("U1", "", "I1", "")])
    users = spark.createDataFrame([("U1", "2023-12-31"), ("U2", "2023-12-31")], "user_id string, account_created_at string")
    devices = spark.createDataFrame([("D1", "2023-12-22")], "device_id string, first_seen_at string")
    rows = {r.user_id: r for r in behaviour.behavioural_features(
        users.withColumn("account_created_at", F.to_date("account_created_at")), df, devices.withColumn("first_seen_at", F.to_date("first_seen_at"))).collect()}
    assert rows["U2"].transaction_count == 0 and rows["U2"].median_transaction_amount == 0
    one = rows["U1"]
    assert (one.transaction_count, one.promo_usage_rate, one.unique_promo_count) == (2, 0.5, 1)
    assert one.unique_device_count == 2  # a blank id counts as a value here
    assert one.recent_unique_entity_count_30d == 2  # but is no entity
    assert one.days_since_first_device_seen == pytest.approx(10 + 10 / 24)


def _smallest_path(neighbours, source, target, max_depth):
    """Breadth-first over whole paths in the order of their ids."""
    level, seen = [[source]], {source}
    for _ in range(max_depth + 1):
        for path in level:
            if path[-1] == target:
                return path
        longer = {}
        for path in level:  # ascending, so the first path to a node is its smallest
            for v in sorted(neighbours.get(path[-1], ())):
                if v not in seen:
                    longer.setdefault(v, path + [v])
        seen |= set(longer)
        level = sorted(longer.values())
    return None


@pytest.mark.parametrize("max_depth", [1, 3, 6])
def test_shortest_paths_meet_in_the_middle(spark, monkeypatch, max_depth):
    """Random graph with a chain, a separate part, repeated arcs and loops; every pair of a request against brute force."""
    chance = random.Random(5)
    links = {(f"n{chance.randrange(40)}", f"n{chance.randrange(40)}") for _ in range(48)}
    links |= {(f"c{i}", f"c{i + 1}") for i in range(8)} | {("c0", "n0"), ("z1", "z2"), ("n3", "n3")}
    both = sorted({(a, b) for a, b in links} | {(b, a) for a, b in links})
    neighbours = {}
    for u, v in both:
        neighbours.setdefault(u, set()).add(v)
    names = [f"n{i}" for i in range(0, 40, 3)] + ["c0", "c4", "c7", "c8", "z1", "gone"]
    pairs = [(a, b) for a in names for b in names] + [("n0", "n3"), (None, "n1"), ("n1", None)]
    levels = []
    cut = V.cut_lineage

    def counted(df):
        stored = cut(df)
        if "origin" in stored.columns:
            levels.append(("next" in stored.columns, stored.count()))
        return stored

    monkeypatch.setattr(V, "cut_lineage", counted)
    rows = V.shortest_paths(spark.createDataFrame(both + both[:9], "u string, v string"), spark.createDataFrame(pairs, "source string, target string"), max_depth=max_depth).collect()
    want = {p: path for p in set(pairs) if None not in p and (path := _smallest_path(neighbours, *p, max_depth)) is not None}
    assert len(rows) == len(want) and {(r.source, r.target): r.path for r in rows} == want
    assert all(r.length == len(r.path) - 1 for r in rows)
    for side in (True, False):  # a front per end and half of the steps, whatever the number of pairs
        own = [n for backward, n in levels if backward == side]
        assert len(own) <= (max_depth + side) // 2 and sum(own) <= len(names) * len(neighbours)


def test_shortest_paths_of_nothing(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "a")], "u string, v string")
    none = spark.createDataFrame([], "source string, target string")
    assert V.shortest_paths(arcs, none).collect() == []
    same = spark.createDataFrame([("x", "x"), ("a", "b")], "source string, target string")
    assert {(r.source, tuple(r.path)) for r in V.shortest_paths(arcs.limit(0), same).collect()} == {("x", ("x",))}
