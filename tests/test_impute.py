import datetime as dt

from lotvalue.operators import impute

D = dt.datetime(2020, 5, 1)
DDL = "id int, sold_date timestamp_ntz, price double, year double, hours double, make_model_key string, raw_category string, region string, make_key string"


def test_cascade_and_order_of_checks(spark):
    rows = [
        (1, D, 1.0, None, 10.0, "m", "c", " R ", " Ford "),
        (2, D, 1.0, 1900.0, 200000.0, "m", "c", "r", "x"),   # out of range, but part of the medians
        (3, D, 1.0, 2000.0, None, "m", "c", "r", "x"),       # (10 + 200000) / 2 = 100005: nulled, not imputed again
        (4, D, 1.0, 2000.0, None, "M", "d", "r", "x"),       # keys are compared as they are: no 'M' hours
        (5, D, 1.0, 2000.0, 30.0, None, "d", "r", "x"),
        (6, D, 1.0, 2000.0, None, None, None, "nan", "x"),   # overall median of 10, 200000, 30
    ]
    df = spark.createDataFrame(rows, DDL)
    out = {r.id: r for r in impute.clean_with_imputation(df, 2021).collect()}
    assert {k: r.hours for k, r in out.items()} == {1: 10.0, 2: None, 3: None, 4: 30.0, 5: 30.0, 6: 30.0}
    assert {k: r.year for k, r in out.items()} == {1: 2013.0, 2: None, 3: 2000.0, 4: 2000.0, 5: 2000.0, 6: 2000.0}
    assert out[1].region == "r" and out[6].region is None and out[4].make_model_key == "m"
    assert out[1].make_key == " Ford "
    assert impute.clean_with_imputation(df, 2021, standardise_make=True).filter("id = 1").first().make_key == "ford"
    covered = {r.field: r.coverage_pct for r in impute.coverage(impute.clean_with_imputation(df, 2021), ["hours"]).collect()}
    assert abs(covered["hours"] - 400 / 6) < 1e-9


def test_group_median_leaves_keyless_rows_without_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 9.0)], "k string, v double")
    out = impute.group_median_column(df, "k", "v", "med").collect()
    assert sorted((r.k or "", r.med or -1) for r in out) == [("", -1), ("a", 2.0), ("a", 2.0), ("a", 2.0)]


def test_hours_by_make_and_age(spark):
    df = spark.createDataFrame([("a", 5.0, 10.0), ("a", 5.0, None), ("a", 6.0, None), (None, 5.0, None)],
                               "make_key string, equipment_age double, hours double")
    out = impute.hours_by_make_and_age(df).collect()
    assert sorted(r.hours_imputed or -1 for r in out) == [-1, -1, 10.0, 10.0]
