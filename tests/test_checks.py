import pytest
from pyspark.sql import functions as F

from ringlens.operators import data_checks as D
from ringlens.operators import distribution as X
from ringlens.operators import splits
from ringlens.registry.base import Data

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Data(spark, SF).tables


def checks(df):
    return {(r.check, r.subject): r.n for r in df.collect()}


def test_broken_foreign_key(tables):
    stray = tables["transactions"].limit(1).withColumn("user_id", F.lit("USR_UNKNOWN"))
    found = checks(D.foreign_keys({**tables, "transactions": tables["transactions"].unionByName(stray)}))
    assert found["foreign_key", "transactions.user_id"] == 1


def test_legit_with_ring(tables):
    users = tables["users"].withColumn("ring_id", F.when(F.col("user_id") == "USR_1", "RING_9").otherwise(F.col("ring_id")))
    clean = checks(D.legit_with_ring(tables["users"]))
    assert not clean and checks(D.legit_with_ring(users)) == {("legit_ring_identity", "users.ring_id"): 1}


def test_missing_key_column(tables):
    found = checks(D.primary_key_duplicates({**tables, "ips": tables["ips"].drop("ip_id")}))
    assert ("primary_key", "ips.ip_id") in found


def test_whitelist_guard_and_name_audit(spark):
    names = spark.createDataFrame([("amount",), ("is_abuse_account",), ("number_of_accounts_sharing_ips",), ("clustering_coefficient",), ("ring_score",)], "name string")
    assert checks(X.whitelist_guard(names)) == {("whitelist_guard", "is_abuse_account"): 1}
    audited = checks(X.feature_name_audit(names))
    assert ("suspicious_name", "ring_score") in audited and ("explicit_label", "is_abuse_account") in audited
    assert not any("sharing" in s or "clustering" in s for _, s in audited)


def test_unparseable_timestamps(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("not a time",), (None,)], "timestamp string")
    assert checks(D.unparseable_timestamps(df)) == {("timestamp_check", "transactions.timestamp"): 2}


def test_overlap_of_identical_and_disjoint_classes(spark):
    rows = [("same", bool(i % 2), float(i // 2)) for i in range(100)]
    rows += [("apart", i < 50, float(i)) for i in range(100)] + [("flat", i < 5, 1.0) for i in range(10)] + [("one", True, float(i)) for i in range(5)]
    got = {r.feature: r.overlap for r in X.overlap(spark.createDataFrame(rows, "feature string, abuse boolean, value double")).collect()}
    assert got["same"] == pytest.approx(1.0) and got["apart"] < 0.1 and got["flat"] == 1.0 and got["one"] == 1.0


def test_summary_counts_by_module(tables):
    findings = D.integrity(tables, "1990-01-01", "2010-01-01").unionByName(D.splits(tables["users"]))
    rows = {r.module: r for r in D.summarize(findings).collect()}
    assert rows["integrity"].errors == 8 and not rows["integrity"].ok  # orders without lines have no entities
    assert rows["splits"].ok


def test_group_split_keeps_groups_together_and_meets_fractions(spark):
    rows = [(f"u{i}", f"g{i // 3}" if i < 1500 else None) for i in range(3000)]
    users = spark.createDataFrame(rows, "user_id string, group_id string")
    pins = spark.createDataFrame([("g1",), ("g2",)], "group_id string")
    out = splits.assign_splits(users, pins).toPandas()
    assert len(out) == 3000 and out.groupby("unit").split.nunique().max() == 1
    assert set(out[out.unit.isin(["g1", "g2"])].split) == {"test"}
    shares = out.split.value_counts(normalize=True)
    assert abs(shares["train"] - 0.70) < 0.01 and abs(shares["val"] - 0.15) < 0.01 and abs(shares["test"] - 0.15) < 0.01
    again = splits.assign_splits(users, pins).toPandas()
    assert dict(zip(out.user_id, out.split)) == dict(zip(again.user_id, again.split))
