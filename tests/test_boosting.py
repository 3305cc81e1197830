"""Boosted trees against a plain NumPy version that looks at every row of every node."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringlens.operators import boosting as B

NAMES = ("a", "b", "c", "d")


def rows_of(spark, n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n), rng.exponential(size=n).round(1), rng.integers(0, 2, n) * 1.0], axis=1)
    noise = rng.normal(scale=0.7, size=n)
    label = (x[:, 0] + 0.5 * (x[:, 1] > 2) - x[:, 2] * x[:, 3] + noise > 0.8).astype(int)
    rows = [(f"u{i}", *map(float, v), int(y)) for i, (v, y) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "user_id string, a double, b double, c double, d double, label int"), x, label


def brute_trees(spark, table, x, label, s, rounds):
    """Greedy trees by the same rules: every cut of every drawn feature tried on the rows themselves."""
    cuts = B.cut_points(table, NAMES, s.bins)
    keys = np.array([r.k for r in table.select(F.xxhash64("user_id", F.lit(s.seed)).alias("k")).collect()])
    weight = (label == 0).sum() / max((label == 1).sum(), 1)
    margin, trees = np.zeros(len(x)), []

    def won(g, h):
        shrunk = np.sign(g) * max(abs(g) - s.l1, 0)
        return shrunk * shrunk / (h + s.l2), -shrunk / (h + s.l2)

    for number in range(rounds):
        chance = np.random.default_rng([s.seed, number])
        drawn = np.sort(chance.permutation(np.arange(4))[: max(1, int(s.feature_share * 4))])
        g, h = B.gradients(margin, label, weight)
        sample = B._chosen(keys, number, s.subsample)
        tree = {}

        def grow(node, rows, depth):
            own = rows & sample
            best = (1e-6, None)
            total = g[own].sum() / B.SCALE, h[own].sum() / B.SCALE
            if depth < s.depth:
                for f in drawn:
                    for cut in cuts[f]:
                        left = own & (x[:, f] <= cut)
                        lg, lh = g[left].sum() / B.SCALE, h[left].sum() / B.SCALE
                        if lh < s.min_child or total[1] - lh < s.min_child:
                            continue
                        gain = won(lg, lh)[0] + won(total[0] - lg, total[1] - lh)[0] - won(*total)[0]
                        if gain > best[0] + 1e-9:
                            best = gain, (f, cut)
            if best[1] is None:
                tree[node] = ("leaf", s.step * won(*total)[1])
                margin[rows] += s.step * won(*total)[1]
                return
            f, cut = best[1]
            tree[node] = (int(f), float(cut))
            grow(2 * node + 1, rows & (x[:, f] <= cut), depth + 1)
            grow(2 * node + 2, rows & (x[:, f] > cut), depth + 1)

        grow(0, np.ones(len(x), bool), 0)
        trees.append(tree)
    return trees, margin


@pytest.mark.parametrize("parts,bins,share", [(1, 16, 1.0), (5, 16, 0.6), (3, 64, 0.8)])
def test_trees_match_brute_force(spark, parts, bins, share, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 3)
    monkeypatch.setattr(B, "BLOCK_ROWS", 700 // parts)
    table, x, label = rows_of(spark)
    s = B.Settings(rounds=8, depth=3, step=0.3, bins=bins, feature_share=share)
    model = B.fit_models(table.repartition(parts), {"m": NAMES}, s)["m"]
    want, margin = brute_trees(spark, table, x, label, s, 8)
    assert model.trees == 8
    for t, tree in enumerate(want):
        for node, (what, value) in tree.items():
            if what == "leaf":
                assert model.feature[t, node] == -1 and model.value[t, node] == pytest.approx(value, rel=1e-9)
            else:
                assert (model.feature[t, node], model.threshold[t, node]) == (what, value)
        assert (model.cover[t] > 0).sum() == len(tree)
    scored = {r.user_id: r.prob for r in B.score(model, table).collect()}
    assert all(scored[f"u{i}"] == pytest.approx(1 / (1 + np.exp(-m)), rel=1e-9) for i, m in enumerate(margin))


def test_models_grow_side_by_side(spark):
    """The trees of a model do not depend on what grows beside it, nor on the number of tasks."""
    table, _, _ = rows_of(spark)
    s = B.Settings(rounds=6, depth=3)
    together = B.fit_models(table.repartition(4), {"one": NAMES, "two": ("d", "a")}, s, rounds={"two": 3})
    alone = B.fit_models(table.coalesce(1), {"two": ("d", "a")}, s, rounds={"two": 3})
    assert together["one"].trees == 6 and together["two"].trees == alone["two"].trees == 3
    x = np.random.default_rng(1).normal(size=(50, 2))
    assert (together["two"].margins(x) == alone["two"].margins(x)).all()


def test_early_stopping_keeps_the_best_round(spark):
    """On labels without a pattern the held-out precision soon stops rising; the trees behind the best round are dropped."""
    table, _, _ = rows_of(spark)
    noise = table.withColumn("label", F.pmod(F.xxhash64("user_id"), F.lit(2)).cast("int"))
    model = B.fit_models(noise.where("user_id < 'u5'"), {"m": NAMES}, B.Settings(rounds=60, patience=5), validation=noise.where("user_id >= 'u5'"))["m"]
    longer = B.fit_models(noise.where("user_id < 'u5'"), {"m": NAMES}, B.Settings(rounds=model.trees))["m"]
    assert 1 <= model.trees < 60
    x = np.random.default_rng(1).normal(size=(50, 4))
    assert (model.margins(x) == longer.margins(x)).all()


def test_models_are_stored_whole(spark, tmp_path):
    table, x, _ = rows_of(spark)
    model = B.fit_models(table, {"m": NAMES}, B.Settings(rounds=5))["m"]
    B.save(spark, model, str(tmp_path))
    loaded = B.load(spark, str(tmp_path))
    assert loaded.names == model.names and (loaded.margins(x) == model.margins(x)).all()


def test_odd_tables(spark):
    """One class, constant and null features, extra columns, an empty table."""
    table, _, _ = rows_of(spark, 40)
    one_class = table.withColumn("label", F.lit(0)).withColumn("prob", F.lit("text")).withColumn("a", F.lit(None).cast("double"))
    model = B.fit_models(one_class, {"m": NAMES}, B.Settings(rounds=3))["m"]
    scored = B.score(model, one_class)
    assert scored.schema["prob"].dataType == T.DoubleType() and all(0 <= r.prob <= 1 for r in scored.collect())
    empty = B.fit_models(table.where("false"), {"m": NAMES}, B.Settings(rounds=3))["m"]
    assert empty.trees == 0 and [r.prob for r in B.score(empty, table.limit(1)).collect()] == [0.5]
