import numpy as np
import pytest
from pyspark.sql import functions as F

from ringlens.functions.ordered import exact_quantiles, order_place, running_totals


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    data = {"hot": rng.normal(size=3000).round(2), "tiny": np.array([4.0]), "ties": np.array([1.0] * 50 + [2.0] * 7)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}).collect()}
    assert set(out) == set(data)
    for k, vs in data.items():
        for name, share in (("q10", 0.1), ("q50", 0.5), ("q95", 0.95)):
            assert out[k][name] == pytest.approx(np.percentile(vs, share * 100))


def test_exact_quantiles_without_keys(spark):
    df = spark.range(1, 102).selectExpr("cast(id AS double) AS v")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first().m == 51.0


def test_quantiles_of_any_doubles(spark):
    """Both signs, powers of two and their neighbours, subnormal and huge values, long ties."""
    rng = np.random.default_rng(8)
    near = [f(2.0 ** e) for e in (-1074, -1022, -3, 0, 1, 9, 1023) for f in (float, lambda v: float(np.nextafter(v, 0)), lambda v: float(np.nextafter(v, np.inf)))]
    data = {"near": near + [-v for v in near], "mixed": (rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500)).tolist(),
            "close": (1.0 + rng.integers(0, 300, 900) * 2.0 ** -52).tolist(), "zero": [0.0, -0.0] * 300 + [5e-324, -5e-324]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(4)
    shares = {f"q{i}": i / 40 for i in range(41)}
    for r in exact_quantiles(df, ["k"], "v", shares).collect():
        ordered = np.sort(np.array(data[r.k]))
        for name, share in shares.items():
            at = share * (len(ordered) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert r[name] == low + (high - low) * (at - np.floor(at)), (r.k, name)


def test_digits_spread_features_of_any_scale(spark):
    """Fifty features, each on a scale of its own: no digit of the first pass holds more than a fiftieth of its feature."""
    values = spark.range(50 * 2000).selectExpr("id % 50 AS feature", "pow(10.0D, id % 50 - 25) * (1 + rand(5)) * 3 AS v")
    shares = values.groupBy("feature", F.floor(order_place(F.col("v")) * 256).alias("digit")).count().groupBy("feature").agg((F.max("count") / 2000).alias("share"))
    assert shares.agg(F.max("share")).first()[0] < 0.02
    got = exact_quantiles(values, ["feature"], "v", {"m": 0.5})
    assert got.count() == 50


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = np.random.default_rng(5)
    rows = [(k, float(i), int(rng.integers(0, 9))) for k in ("a", "b") for i in rng.permutation(700)]
    df = spark.createDataFrame(rows, "k string, o double, n long")
    got = {(r.k, r.o): r.cum_n for r in running_totals(df, ["k"], "o", ["n"], descending=descending).collect()}
    for k in ("a", "b"):
        total = 0
        for _, o, n in sorted((r for r in rows if r[0] == k), key=lambda r: r[1], reverse=descending):
            total += n
            assert got[k, o] == total
