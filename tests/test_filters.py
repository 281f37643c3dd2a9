from lotvalue.functions.rules import CATEGORY_RULES
from lotvalue.operators import filters


def test_funnel_counts_each_step_once(spark):
    df = spark.createDataFrame([(500.0, "a"), (1000.0, None), (2_000_000.0, "b"), (2_000_001.0, "c"), (None, "d")],
                               "price double, make_key string")
    steps = filters.training_steps(df, require=["make_key", "not_there"])
    assert [n for n, _ in steps] == ["price", "has_make_key"]
    out = filters.funnel(df, steps).collect()
    assert [(r.rows_left, r.rows_removed) for r in out] == [(2, 3), (1, 1)]
    assert filters.filter_training(df, require=["make_key", "not_there"]).count() == 1


def test_category_filter_is_null_safe(spark):
    df = spark.createDataFrame([("Farm TRACTOR", 5000.0), (None, 6000.0), ("tractors", 4999.0), ("truck", 6000.0)],
                               "raw_category string, price double")
    assert filters.filter_category(df, CATEGORY_RULES[0]).count() == 1


def test_residual_segment_needs_make_key(spark):
    row = "raw_category string, price double, sold_date string, make_key string, year double, hours double, region string"
    df = spark.createDataFrame([("Misc", 1000.0, "2020", "x", 1.0, 1.0, "r"), (None, 2000.0, "2020", "x", 1.0, 1.0, "r"),
                                ("Misc", 1000.0, "2020", None, 1.0, 1.0, "r"), ("Truck", 5000.0, "2020", "x", 1.0, 1.0, "r"),
                                ("Misc", 500001.0, "2020", "x", 1.0, 1.0, "r")], row)
    assert filters.filter_other(df).count() == 2


def test_complete_falls_back_to_make_key(spark):
    df = spark.createDataFrame([(1.0, "d", "m", 1.0, 1.0, "r"), (1.0, "d", None, 1.0, 1.0, "r")],
                               "price double, sold_date string, make_key string, year double, hours double, region string")
    assert filters.require_complete(df).count() == 1
