from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlens.operators import attribution as A
from ringlens.operators import boosting
from ringlens.operators import evidence as V
from ringlens.operators import explain as X
from ringlens.operators import models as M
from ringlens.operators import typed_graph as G

NAMES = ("f0", "f1", "f2", "f3")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 4))
    rows = [(f"u{i}", *map(float, r), int(r[0] + r[1] > 0), "train") for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "user_id string, f0 double, f1 double, f2 double, f3 double, label int, split string")


@pytest.fixture(scope="module")
def boosted(table):
    return M.train_boosted(table, NAMES, rounds=4, depth=3)


def test_attributions_add_up_to_the_log_odds(table, boosted):
    base = A.base_value(A.leaves(boosted))
    sums = {r.user_id: r.s for r in A.attributions(boosted, table, NAMES).groupBy("user_id").agg(F.sum("attribution").alias("s")).collect()}
    for r in M.score(boosted, table).select("user_id", "prob").collect():
        assert sums[r.user_id] + base == pytest.approx(np.log(r.prob / (1 - r.prob)), abs=1e-6)


def test_attributions_match_brute_force(table, boosted):
    nodes = {(n.tree, n.node): n for n in boosting.nodes(table.sparkSession, boosted).collect()}

    def expected(x, known, tree, number=0):
        n = nodes[tree, number]
        if n.left < 0:
            return n.value
        if n.feature in known:
            return expected(x, known, tree, n.left if x[n.feature] <= n.threshold else n.right)
        return sum(nodes[tree, c].cover / n.cover * expected(x, known, tree, c) for c in (n.left, n.right))

    x = np.array(table.where("user_id = 'u3'").select(*NAMES).first())
    value = {s: sum(expected(x, s, t) for t in {t for t, _ in nodes}) for k in range(5) for s in combinations(range(4), k)}
    got = A.attribute(x[None, :], A.leaves(boosted))[0]
    for i in range(4):
        want = sum(
            factorial(len(s)) * factorial(3 - len(s)) / factorial(4) * (value[tuple(sorted((*s, i)))] - value[s])
            for k in range(4) for s in combinations([j for j in range(4) if j != i], k)
        )
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_counterfactuals_of_a_logistic_model(table):
    model = M.train_logistic(table, NAMES)
    rows = X.counterfactuals(table, X.training_statistics(table, NAMES), lambda t: M.score(model, t), NAMES)
    for r in rows.collect():
        assert 0 <= r.counterfactual_probability <= 1
        assert r.probability_delta == pytest.approx(r.counterfactual_probability - r.original_probability, abs=2e-6)
    nested = X.ordered_counterfactuals(rows).collect()
    for r in nested:
        deltas = [abs(c.probability_delta) for c in r.counterfactuals]
        assert deltas == sorted(deltas, reverse=True) and len(deltas) <= 4


def test_early_stopping_and_importance(table):
    model = M.train_boosted(table, NAMES, rounds=12, depth=2, validation=table.limit(60), feature_share=1.0)
    assert 1 <= model.trees <= 12
    top = M.importance(table.sparkSession, model, method="weight").collect()
    assert {top[0].feature, top[1].feature} == {"f0", "f1"}
    groups = M.grouped_importance(M.importance(table.sparkSession, model, method="gain")).collect()
    assert [(r.group, r.features) for r in groups] == [("unknown", len(top))] and groups[0].share == pytest.approx(1.0)


def test_trees_without_a_split_have_no_attributions(table):
    """Few rows a leaf may hold: some trees are a single leaf, and sums still give the log-odds."""
    model = M.train_boosted(table, NAMES, rounds=12, depth=2, step=0.3, min_child=13.0, subsample=0.5)
    single = (model.feature < 0).all(axis=1)
    assert single.any() and not single.all()
    base = A.base_value(A.leaves(model))
    sums = A.attributions(model, table, NAMES).groupBy("user_id").agg(F.sum("attribution").alias("s")).join(M.score(model, table), "user_id").collect()
    assert all(r.s + base == pytest.approx(np.log(r.prob / (1 - r.prob)), abs=1e-9) for r in sums)


def test_audited_refuses_label_columns(table):
    with pytest.raises(ValueError, match="ring_hint"):
        M.audited(table.withColumn("ring_hint", F.lit(1.0)), (*NAMES, "ring_hint"))
    assert M.audited(table, NAMES).count() == 240


def test_unknown_group_is_an_error():
    with pytest.raises(ValueError):
        M.group_features(("nonsense",))
    assert len(M.group_features(("direct",))) == 31


def test_paths_are_bounded_and_exist(txns):
    rows = [(f"U{i:02d}", "D0", "", "") for i in range(40)] + [("U00", "D0", "", "")] * 3
    rows += [("A", "D1", "", ""), ("B", "D1", "", ""), ("B", "", "I1", ""), ("C", "", "I1", ""), ("C", "D2", "", ""), ("D", "D2", "", "")]
    edges = G.user_entity_edges(txns(rows))
    paths = V.multi_hop_paths(edges)
    found = paths.collect()
    per_user = {}
    for r in found:
        per_user.setdefault(r.user_id, []).append(r)
    assert max(len(v) for v in per_user.values()) == 10
    assert [tuple(r.nodes) for r in sorted(per_user["A"], key=lambda r: r.position)] == [
        ("A", "D1", "B"), ("A", "D1", "B", "I1", "C"), ("A", "D1", "B", "I1", "C", "D2", "D")]
    first = next(r for r in per_user["U05"] if r.position == 1)
    assert first.nodes[-1] == "U00" and first.path_strength == 4.0
    assert X.audit_path_edges(paths, edges).isEmpty()


def test_lists_are_ranked_without_loss(txns):
    edges = G.user_entity_edges(txns([("U1", f"D{i:02}", "", "") for i in range(25)]))
    rows = V.entity_lists(V.entities(edges)).collect()
    assert sorted((r.rank, r.entity_id) for r in rows) == [(i + 1, f"D{i:02}") for i in range(25)]


def test_label_fields_are_found_at_any_depth(spark):
    clean = spark.sql("SELECT 'a' AS user_id, array(struct(1 AS score)) AS items")
    leaky = spark.sql("SELECT 'a' AS user_id, array(struct(1 AS ring_id)) AS items")
    assert X.label_fields_in(clean) == [] and X.label_fields_in(leaky) == ["ring_id"]


def test_request_limit(spark):
    ids = spark.range(5).selectExpr("cast(id AS string) AS user_id")
    assert V.only_listed(ids, ids.limit(2), limit=3).count() == 2
    with pytest.raises(ValueError):
        V.only_listed(ids, ids, limit=3)


def test_fewer_hops_are_the_same_paths_cut_short(spark):
    """A chain of pairs: every user has few paths, so the second and third hop extend those of the hop before."""
    rows = [(f"U{i}", f"D{j}", "uses_device", 1 + i % 3) for i in range(9) for j in (i // 2, 10 + (i + 1) // 2)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, weight bigint")
    whole = [tuple(r) for r in V.multi_hop_paths(edges).collect()]
    assert {r[1] for r in whole} == {1, 2, 3}
    for hops in (1, 2):
        short = V.multi_hop_paths(edges, max_hops=hops).collect()
        assert sorted(map(tuple, short)) == sorted(r for r in whole if r[1] <= hops)
