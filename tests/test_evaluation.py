import numpy as np
import pytest

from ringlens.operators import bootstrap
from ringlens.operators import evaluation as E
from ringlens.operators import risk as R
from ringlens.operators import thresholds as TH


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("a", 1, 0.9), ("b", 0, 0.8), ("c", 1, 0.7), ("d", 1, 0.4), ("e", 0, 0.4), ("f", 0, 0.1)]
    return spark.createDataFrame(rows, "user_id string, label int, prob double")


def test_metrics_at_a_threshold(scored):
    r = TH.at_threshold(scored, 0.7).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert r.precision == pytest.approx(2 / 3) and r.recall == pytest.approx(2 / 3) and r.specificity == pytest.approx(2 / 3)
    none = TH.at_threshold(scored, 0.95).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_areas_by_hand(scored):
    # Pairs: 0.9 beats 3; 0.7 beats 2; 0.4 beats 1 and ties 1.
    assert TH.roc_auc(scored).first().roc_auc == pytest.approx(6.5 / 9)
    assert TH.average_precision(scored).first().pr_auc == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)


def test_strategies(scored):
    curve = TH.threshold_curve(scored)
    assert curve.count() == 6  # five distinct scores and 1.0
    rows = {r.strategy: r for r in TH.all_strategies(curve).collect()}
    assert rows["max_f1"].threshold == 0.4 and rows["high_recall"].threshold == 0.4
    assert rows["balanced"].threshold == 0.7
    assert rows["low_fp_rate"].threshold == 0.7
    impossible = TH.select_threshold(curve, "high_recall", min_recall=2.0).first()
    assert impossible.threshold == rows["max_f1"].threshold
    with pytest.raises(ValueError):
        TH.select_threshold(curve, "best")


def test_cost_curve(scored):
    r = E.cost(scored, 0.7).first()
    assert (r.fp_cost, r.fn_cost, r.total_cost) == (5000.0, 25000.0, 30000.0)
    curve = E.cost_curve(scored).orderBy("threshold").collect()
    assert len(curve) == 100 and (curve[0].fp, curve[0].fn) == (3, 0) and curve[-1].fn == 3
    for point in curve:
        assert point.fn == sum(1 for p in (0.9, 0.7, 0.4) if p < round(point.threshold * 99) / 99)
    assert E.cost_optimal(E.cost_curve(scored)).first().total_cost == 10000.0


def test_bootstrap_is_deterministic_and_covers_the_estimate(spark):
    rows = [(f"u{i}", int(i % 3 == 0), ((i * 37) % 100) / 200 + (0.4 if i % 3 == 0 else 0.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "user_id string, label int, prob double")
    first = {r.metric: (r.lower, r.upper) for r in E.bootstrap_intervals(df, 0.5, replicates=60).collect()}
    again = {r.metric: (r.lower, r.upper) for r in E.bootstrap_intervals(df, 0.5, replicates=60).collect()}
    assert first == again and set(first) == {"precision", "recall", "f1", "pr_auc", "roc_auc"}
    point = TH.metric_bundle(df, 0.5).first()
    for metric, (lower, upper) in first.items():
        assert lower <= round(point[metric], 4) <= upper and upper - lower < 0.3


@pytest.mark.parametrize("rows", [3, 256])
def test_bootstrap_matches_brute_force(spark, monkeypatch, rows):
    """Every replicate against its own list of drawn rows, with long ties and matrices that end inside them."""
    monkeypatch.setattr(bootstrap, "ROWS", rows)
    rng = np.random.default_rng(4)
    data = [(f"u{i}", int(rng.random() < 0.4), float(rng.choice([0.1, 0.25, 0.5, 0.5, 0.75, round(rng.random(), 3)]))) for i in range(300)]
    data += [("none", None, 0.5), ("gone", 1, None)]
    df = spark.createDataFrame(data, "user_id string, label int, prob double").repartition(4)
    keys = {r.user_id: r.k for r in df.selectExpr("user_id", "xxhash64(user_id, 42) AS k").collect()}
    drawn = bootstrap.multiplicities(np.array([keys[u] for u, *_ in data[:-2]]), 20)
    assert 0.9 < drawn.mean() < 1.1 and drawn.max() >= 4
    got = {r.replicate: r for r in bootstrap.bootstrap_metrics(df, 0.5, replicates=20).collect()}
    assert sorted(got) == list(range(1, 21))
    for b in range(20):
        sample = [(y, p) for (_, y, p), n in zip(data, drawn[:, b]) for _ in range(n)]
        pos, neg = [p for y, p in sample if y], [p for y, p in sample if not y]
        tp, fp = sum(p >= 0.5 for p in pos), sum(p >= 0.5 for p in neg)
        roc = sum((a > c) + 0.5 * (a == c) for a in pos for c in neg) / (len(pos) * len(neg))
        ap = sum(sum(p >= s for p in pos) / sum(p >= s for _, p in sample) for s in pos) / len(pos)
        want = (tp / (tp + fp), tp / len(pos), 2 * tp / (tp + fp + len(pos)), ap, roc)
        r = got[b + 1]
        assert (r.precision, r.recall, r.f1, r.pr_auc, r.roc_auc) == pytest.approx(want, rel=1e-12)


def test_ring_detection(spark, scored):
    users = spark.createDataFrame(
        [("a", True, "R1", "x"), ("d", True, "R1", "x"), ("c", True, "R2", "y"), ("gone", True, "R2", "y"), ("lost", True, "R2", "y"), ("b", False, "", "")],
        "user_id string, is_abuse_account boolean, ring_id string, ring_type string")
    rings = {r.ring_id: r for r in E.ring_detection(users, scored, 0.7).collect()}
    assert rings["R1"].detected and rings["R1"].detection_rate == 0.5
    assert not rings["R2"].detected and rings["R2"].ring_size == 3 and rings["R2"].mean_member_prob == round(0.7 / 3, 4)
    total = {r.ring_type: (r.total, r.detected) for r in E.ring_summary(E.ring_detection(users, scored, 0.7)).collect()}
    assert total == {"all": (2, 1), "x": (1, 1), "y": (1, 0)}


def test_risk_trio(spark):
    df = spark.createDataFrame([("U1", 0.1), ("U2", 0.6), ("U3", 0.9)], "user_id string, prob double")
    decided = R.decide(df)
    assert {r.user_id: r.decision for r in decided.collect()} == {"U1": "allow", "U2": "review", "U3": "escalate"}
    assert [r.user_id for r in R.review_queue(decided).collect()] == ["U3", "U2"]
    with pytest.raises(ValueError):
        R.top_of_queue(decided, 0)


@pytest.mark.parametrize("score, decision, priority", [(0.19, "allow", None), (0.2, "monitor", "normal"), (0.5, "review", "high"), (0.8, "escalate", "urgent")])
def test_policy_bands(spark, score, decision, priority):
    row = R.decide(spark.createDataFrame([("u", score)], "user_id string, prob double")).first()
    assert (row.decision, row.review_priority) == (decision, priority)


def test_reasons(spark):
    df = spark.createDataFrame(
        [("U1", 2, 0, 0, 1, 3, 0, 0.75, 2.5, 0.5, 30.0, 0.0, 0.0, 0.2, "increases_risk", "Account age")],
        "user_id string, n_devices int, n_ips int, n_addresses int, n_payments int, n_related int, n_paths int, community_density double, "
        "transaction_frequency double, promo_usage_rate double, account_age_days double, night_activity_rate double, "
        "weekend_activity_rate double, failed_transaction_rate double, top_direction string, top_description string")
    found = {r.code: r.description for r in df.select(R.reasons(df).alias("r")).first().r}
    assert set(found) == {"GRAPH_SHARED_DEVICE", "GRAPH_SHARED_PAYMENT", "GRAPH_CONNECTED_ACCOUNTS", "GRAPH_DENSE_COMMUNITY",
                          "BEHAVIORAL_HIGH_ACTIVITY", "BEHAVIORAL_HIGH_FAIL_RATE", "MODEL_HIGH_RISK_FACTOR"}
    assert found["GRAPH_SHARED_DEVICE"] == "User shares 2 device(s)."
    assert found["GRAPH_DENSE_COMMUNITY"].endswith("(density: 0.75).")
