"""A cross-section of the registered queries against DuckDB at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "beh_all_features", "beh_25_account_features", "gr_06_nodes", "prj_02_edges_with_low_cap", "prj_all_split_edges",
    "gf_projection_features_per_split", "gf_24_betweenness_per_split", "com_03_sizes_and_density", "com_04_components",
    "spl_02_pinned_groups", "val_33_summary", "val_20_overlap", "sum_03_amount_stats", "ev_11_metric_bundle", "ev_13_cost_curve",
    "ev_17_ring_detection", "inv_06_paths_1_hop", "inv_07_paths_2_hop_sparse", "inv_12_ego_network", "rsk_06_review_queue",
)


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for table in TABLES:
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, connection, name):
    outcome, _ = compare(spark, connection, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert outcome.startswith("ok"), outcome


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 150
