import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ringlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("ringlens-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def txns(spark):
    """Build transactions from (user, device, ip, promo) tuples."""
    def build(rows):
        full = [
            (f"T{i}", u, "2024-01-01 10:00:00", 10.0, "M1", "", dev, ip, "", promo, "success", False, "")
            for i, (u, dev, ip, promo) in enumerate(rows)
        ]
        return spark.createDataFrame(
            full, "transaction_id string, user_id string, timestamp string, amount double, merchant_id string, "
            "payment_instrument_id string, device_id string, ip_id string, address_id string, promo_id string, "
            "transaction_status string, is_abuse_transaction boolean, ring_id string",
        ).selectExpr("* EXCEPT (timestamp)", "cast(timestamp AS timestamp) AS timestamp")
    return build


@pytest.fixture(scope="session")
def user_graph(spark):
    from ringlens.operators.projection import COUNTS, UserGraph

    def build(pairs, nodes):
        edges = [("all", min(a, b), max(a, b)) for a, b in pairs]
        df = spark.createDataFrame(edges, "view string, a string, b string").selectExpr(
            "*", "1L AS shared_device_count", *[f"0L AS {c}" for c in COUNTS[1:]], "1L AS weight", "1 AS shared_entity_types")
        return UserGraph(df, spark.createDataFrame([("all", n) for n in nodes], "view string, user_id string"), None)
    return build
