import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotvalue.functions import rules
from lotvalue.operators import evaluate, profiling, routing, valuation


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    y = rng.uniform(1000, 50000, 500)
    p = y * rng.uniform(0.7, 1.4, 500)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "price double, prediction double"), y, p


def test_metrics(scored):
    df, y, p = scored
    row = evaluate.metrics(df.withColumn("g", F.lit(1)), ["g"]).first()
    assert row.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)))
    assert row.mape == pytest.approx(np.mean(np.abs(y - p) / y) * 100)
    assert row.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))


def test_error_analysis_and_ecdf(scored):
    df, y, p = scored
    pct = np.abs((y - p) / y * 100)
    row = evaluate.error_analysis(df).first()
    assert row.median_pct_error == pytest.approx(np.median(pct))
    assert row.n_within_10 == (pct <= 10).sum() and row.pct_within_20 == pytest.approx((pct <= 20).mean() * 100)
    for r in evaluate.error_ecdf(df, step=1.0).collect():
        assert r.n_upto == (pct <= r.pct_error).sum()
        assert r.cumulative_pct == pytest.approx((pct <= r.pct_error).mean() * 100)
    assert evaluate.error_ecdf(df, step=1.0).agg({"n_upto": "max"}).first()[0] == len(pct)


def test_histogram_matches_numpy(scored):
    df, y, _ = scored
    counts, edges = np.histogram(y, bins=20)
    rows = profiling.histogram(df, F.col("price"), 20).orderBy("bin").collect()
    assert [r.n for r in rows] == list(counts) and np.allclose([r.lower for r in rows], edges[:-1])
    same = df.limit(3).withColumn("price", F.lit(5.0))
    assert sum(r.n for r in profiling.histogram(same, F.col("price"), 4).collect()) == 3


def test_box_plot(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [(None, 5.0)], "region string, price double")
    row = profiling.box_plot(df, "region", "price").first()
    assert (row.q1, row["median"], row.q3, row.whisker_low, row.whisker_high, row.outliers, row.n) == (2, 3, 4, 1, 4, 1, 5)


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 2.0), (dt.datetime(2020, 1, 1), 3.0)], "sold_date timestamp_ntz, price double")
    assert profiling.yearly_sales(df).first().median_price == 2.0


def test_goals(spark):
    df = spark.createDataFrame([(9.0, 0.9, 20000.0), (10.0, 0.85, None)], "test_mape double, test_r2 double, test_rmse double")
    assert [r.goals_met for r in evaluate.goal_check(df).collect()] == [2, 0]


REGISTRY = "tier string, model_key string, method string, n_train int, test_rmse double, test_mape double, test_r2 double"


def registry(spark, *without):
    rows = [("make_category", "ford_trucks", "log", 9, 1.0, 10.0, 0.5), ("category", "tractors", "log", 9, 1.0, 20.0, 0.5),
            ("category", "trucks_and_trailers", "log", 9, 1.0, 25.0, 0.5), ("generic", "other", "log", 9, 1.0, 30.0, 0.5),
            ("category", "tractors", "regular", 9, 1.0, 40.0, 0.5)]
    return spark.createDataFrame([r for r in rows if r[0] not in without], REGISTRY)


def test_routing_prefers_the_specific_model(spark):
    requests = spark.createDataFrame([(1, "Ford", "Trucks"), (2, "kubota", "Trucks"), (3, "x", "Misc"), (4, None, None),
                                      (5, "x", "Excavator")], "id int, make_key string, raw_category string")
    got = {r.id: (r.tier, r.model_key) for r in routing.route(requests, registry(spark)).collect()}
    assert got == {1: ("make_category", "ford_trucks"), 2: ("category", "trucks_and_trailers"), 3: ("generic", "other"),
                   4: ("generic", "other"), 5: ("generic", "other")}
    none = routing.route(requests, registry(spark, "generic"))
    assert {r.id: r.tier for r in none.collect()}[5] is None and none.count() == 5
    assert {r.tier: r.n_requests for r in routing.route_coverage(none).collect()} == {"make_category": 1, "category": 1, "none": 3}


def test_improvements_and_ensemble(spark):
    gain = routing.method_improvement(registry(spark)).collect()
    assert [(r.model_key, r.gain_pct) for r in gain] == [("tractors", 50.0)]
    pairs = spark.createDataFrame([("ford_trucks", "trucks_and_trailers")], "make_category_key string, category_key string")
    assert routing.specific_improvement(registry(spark), pairs).first().change_pct == pytest.approx(-60.0)
    p = spark.createDataFrame([(1, "log", 10.0), (1, "regular", 20.0), (1, "third", 30.0), (2, "log", 10.0)],
                              "id int, method string, prediction double")
    assert [tuple(r) for r in routing.ensemble(p, ["id"]).collect()] == [(1, pytest.approx(17.0))]


def test_band_and_comparison(spark):
    df = spark.createDataFrame([(100.0, 20.0, "log", 130.0, 20.0, "regular"), (100.0, 150.0, "log", 90.0, 200.0, "regular"),
                                (0.0, 10.0, "log", 5.0, 11.0, "regular")],
                               "prediction double, test_mape double, method string, other_prediction double, other_test_mape double, other_method string")
    band = valuation.confidence_band(df).collect()
    assert [(r.lower, r.upper) for r in band] == [(80.0, 120.0), (0.0, 250.0), (0.0, 0.0)]
    both = valuation.compare_methods(df).collect()
    assert [(r.difference, r.difference_pct, r.better_method) for r in both] == [
        (30.0, 30.0, "regular"), (10.0, 10.0, "log"), (5.0, 0.0, "log")]


def test_insight_bands_are_closed_below(spark):
    df = spark.createDataFrame([(2000.0, 2990.0), (2000.0, 3000.0), (2000.0, 6000.0), (2000.0, 10000.0), (2010.0, 5.0),
                                (2000.0, 0.0), (None, 5.0)], "year double, hours double")
    words = [r.usage_insight.split()[0] for r in valuation.utilization_insight(df, 2010).collect()]
    assert words == ["Light", "Normal", "Heavy", "Extreme", "Enter", "Enter", "Enter"]
    mood = spark.createDataFrame([(121.0,), (120.0,), (90.0,), (None,)], "barometer double")
    assert [r.market_sentiment.split()[0] for r in valuation.market_sentiment(mood).collect()] == ["Strong", "Stable", "Weak", "Weak"]


def test_summary_and_monitor(spark, tmp_path):
    df = spark.createDataFrame([("john-deere", "great_plains", 2010.0, 5.0), ("a_b", "x", 2000.0, 100.0)],
                               "make_key string, region string, year double, hours double")
    out = valuation.equipment_summary(df, 2010).collect()
    assert [(r.display_make, r.display_region, r.age_years, r.display_hours_per_year) for r in out] == [
        ("John Deere", "Great Plains", 0.0, None), ("A B", "X", 10.0, 10.0)]
    path = str(tmp_path / "log")
    for price in (90.0, 220.0):
        valuation.log_predictions(spark.createDataFrame([(int(price), price)], "id int, prediction double"), path)
    sales = spark.createDataFrame([(90, 100.0), (220, 200.0)], "id int, price double")
    row = valuation.monitor(spark.read.parquet(path).withColumn("g", F.lit(1)), sales, ["id"], ["g"]).first()
    assert (row.n, row.mape) == (2, pytest.approx(10.0))


def test_reference_lists_and_top_models(spark):
    df = spark.createDataFrame([("Truck Tractor", "ford", "r1", "b"), ("Truck Tractor", "ford", "r1", "a"), ("Misc", "x", None, "c"),
                                (None, None, "r2", "d")], "raw_category string, make_key string, region string, raw_model string")
    got = {(r.category_key, r.kind, r.value) for r in profiling.reference_lists(df).collect()}
    assert got == {("tractors", "make", "ford"), ("tractors", "region", "r1"), ("trucks_and_trailers", "make", "ford"),
                   ("trucks_and_trailers", "region", "r1"), ("other", "make", "ford"), ("other", "make", "x"),
                   ("other", "region", "r1"), ("other", "region", "r2")}
    top = profiling.top_models(df, top=1).collect()
    assert {(r.category_key, r.model) for r in top} == {("tractors", "a"), ("trucks_and_trailers", "a")}
    assert rules.OTHER.min_price == 1000


def test_column_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (-0.0, "a"), (0.0, None), (None, None)], "x double, s string")
    got = {r.column_name: (r.dtype, r.non_null, r.null_count, r.coverage_pct, r.n_distinct)
           for r in profiling.column_profile(df).collect()}
    assert got == {"x": ("double", 3, 1, 75.0, 2), "s": ("string", 2, 2, 50.0, 1)}
    near = {r.column_name: r.n_distinct for r in profiling.column_profile(df, approximate=True).collect()}
    assert near["s"] == 1
