from itertools import combinations

from ringlens.operators import communities as C


def two_cliques(user_graph):
    left, right = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(5)]
    pairs = list(combinations(left, 2)) + list(combinations(right, 2)) + [("a4", "b0")]
    return user_graph(pairs, left + right + ["z"]), left, right


def test_two_cliques_with_a_bridge(user_graph):
    graph, left, right = two_cliques(user_graph)
    labels = C.louvain(graph)
    by_user = {r.user_id: r.raw for r in labels.collect()}
    assert len({by_user[u] for u in left}) == 1 and len({by_user[u] for u in right}) == 1
    assert len(set(by_user.values())) == 3
    rows = {r.user_id: r for r in C.community_features(labels, graph).collect()}
    assert rows["a0"].community_id == 0 and rows["b0"].community_id == 1 and rows["z"].community_id == 2
    assert (rows["a0"].community_size, rows["a0"].community_edge_count, rows["a0"].community_density) == (5, 10, 1.0)
    assert (rows["z"].community_size, rows["z"].community_density) == (1, 0.0)
    singles = graph.nodes.selectExpr("view", "user_id", "user_id AS raw")
    assert C.modularity(graph, labels).first().modularity > C.modularity(graph, singles).first().modularity


def test_communities_that_fall_apart_are_split(user_graph, spark):
    graph, left, right = two_cliques(user_graph)
    rows = [("all", u, "both" if u in left[:4] + right[1:] else "rest") for u in [*left, *right, "z"]]
    labels = spark.createDataFrame(rows, "view string, user_id string, raw string")
    got = {r.user_id: r.raw for r in C.connected_parts(graph, labels).collect()}
    assert got == {**{u: "a0" for u in left[:4]}, **{u: "b1" for u in right[1:]}, "a4": "a4", "b0": "a4", "z": "z"}
    before, after = (C.modularity(graph, x).first().modularity for x in (labels, spark.createDataFrame([("all", u, r) for u, r in got.items()], labels.schema)))
    assert after > before


def test_graph_without_edges(user_graph, spark):
    graph, _, _ = two_cliques(user_graph)
    empty = type(graph)(graph.edges.limit(0), graph.nodes, None)
    assert C.louvain(empty).where("raw <> user_id").isEmpty()


def test_numbering_by_size_then_smallest_member(spark):
    rows = [("all", f"u{i}", f"c{i // 2}") for i in range(40)] + [("all", "zz", "big"), ("all", "zy", "big"), ("all", "zx", "big")]
    labels = spark.createDataFrame(rows, "view string, user_id string, raw string")
    got = {r.raw: r.community_id for r in C.number_communities(labels).collect()}
    order = sorted({r[2] for r in rows}, key=lambda c: (-sum(r[2] == c for r in rows), min(r[1] for r in rows if r[2] == c)))
    assert got == {c: i for i, c in enumerate(order)}


def test_numbering_spreads_one_size_over_ranges(spark):
    rows = [("all", f"USER_{i:06d}", f"USER_{i:06d}") for i in range(2000)]
    labels = spark.createDataFrame(rows, "view string, user_id string, raw string")
    got = {r.raw: r.community_id for r in C.number_communities(labels).collect()}
    assert got == {r[1]: i for i, r in enumerate(rows)}


def test_views_settle_by_themselves(spark, user_graph):
    graph, left, right = two_cliques(user_graph)
    twice = type(graph)(
        graph.edges.unionByName(graph.edges.selectExpr("'other' AS view", *[c for c in graph.edges.columns if c != "view"]).where("a <> 'a4' OR b <> 'b0'")),
        graph.nodes.unionByName(graph.nodes.selectExpr("'other' AS view", *[c for c in graph.nodes.columns if c != "view"])), None)
    by_view = {}
    for row in C.louvain(twice).collect():
        by_view.setdefault(row.view, {})[row.user_id] = row.raw
    assert len(by_view) == 2
    for labels in by_view.values():
        assert len({labels[u] for u in left}) == 1 and len({labels[u] for u in right}) == 1 and len(set(labels.values())) == 3
