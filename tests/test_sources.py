import pytest

from ringlens import schema as S
from ringlens.session import shared_folder
from ringlens.sources import tables as IO


@pytest.fixture(scope="module")
def small(spark):
    one = {name: spark.createDataFrame([], schema) for name, schema in S.TABLES.items()}
    one["transactions"] = spark.sql(
        "SELECT 'T1' AS transaction_id, 'U1' AS user_id, TIMESTAMP'2024-02-03 04:05:06' AS timestamp, 1.5D AS amount, 'M' AS merchant_id, "
        "'P' AS payment_instrument_id, 'D' AS device_id, 'I' AS ip_id, 'A' AS address_id, '' AS promo_id, 'success' AS transaction_status, "
        "true AS is_abuse_transaction, 'R' AS ring_id")
    return one


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_tables_round_trip(spark, small, file_format):
    folder = shared_folder(spark)
    counts = {r.table: r.rows for r in IO.write_tables(small, folder, file_format=file_format).collect()}
    assert counts["transactions"] == 1 and counts["users"] == 0
    row = IO.load_tables(spark, folder, file_format=file_format)["transactions"].first()
    assert row.promo_id == "" and row.ring_id == "R" and row.is_abuse_transaction is True
    assert str(row.timestamp) == "2024-02-03 04:05:06"


def test_missing_table_is_an_error(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        IO.load_tables(spark, shared_folder(spark))


def test_bad_times_become_null(spark):
    df = spark.createDataFrame([("x", "2024-01-01 00:00:00"), ("y", "soon")], "user_id string, timestamp string")
    rows = {r.user_id: r.timestamp for r in IO.normalize("other", df).collect()}
    assert rows["x"] is not None and rows["y"] is None


def test_one_split_reads_only_its_files(spark):
    cols = ", ".join(f"1D AS {c}" for c in S.BASELINE_FEATURES)
    table = spark.sql(f"SELECT 'u' AS user_id, {cols}, 1 AS label, 'train' AS split UNION ALL SELECT 'v', {', '.join('2D' for _ in S.BASELINE_FEATURES)}, 0, 'test'")
    folder = shared_folder(spark)
    shapes = IO.write_features(table, folder).collect()
    assert {(r.variant, r.split, r.rows, r["columns"]) for r in shapes} == {("baseline", "train", 1, 25), ("baseline", "test", 1, 25)}
    one = IO.load_features(spark, folder, "baseline", "test")
    assert [r.user_id for r in one.collect()] == ["v"]
    assert "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(ValueError):
        IO.load_features(spark, folder, "nonsense")
