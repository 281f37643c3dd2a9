import math

from pyspark.sql import functions as F

from lotvalue.functions.columns import clip, coerce_number, nan_to_null
from lotvalue.operators.cleaning import (
    clean_auctions, invalid_price_count, prepare_requests, request_model_key, validate_requests,
)


def one(df):
    return [r[0] for r in df.collect()]


def test_text_numbers_must_be_plain(spark):
    cells = ["12d", "1,234", "", " 12 ", "1e3", ".5", "-5", "inf", "nan", "\t7\n", None]
    df = spark.createDataFrame([(c,) for c in cells], "x string")
    assert one(df.select(coerce_number(F.col("x"), "string"))) == [
        None, None, None, 12.0, 1000.0, 0.5, -5.0, math.inf, None, 7.0, None]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,), (None,)], "x double")
    assert one(df.select(nan_to_null(F.col("x")))) == [None, 1.0, None]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (51.0,), (None,), (7.0,)], "x double")
    assert one(df.select(clip(F.col("x"), 0.0, 50.0))) == [0.0, 50.0, None, 7.0]


def test_ranges_and_keys(spark):
    rows = [
        ("2020-01-01", -5.0, -1.0, 1949.0, " Mid\tWest ", "ia", " John-Deere ", "NA-NA"),
        ("bad", 0.0, 0.0, 1950.0, "nan", "None", "None", " X-1 "),
        (None, None, 100000.0, 2003.0, "", " tx\t", "\tX ", "nan"),
        ("2020-02-03", 10.0, 100001.0, 2004.0, None, None, None, None),
        ("2020-02-03", 10.0, math.nan, math.nan, "a", "b", "c", "d"),
    ]
    df = spark.createDataFrame(rows, "sold_date string, price double, hours double, year double, region string, "
                                     "state string, make_key string, make_model_key string")
    out = clean_auctions(df, as_of_year=2002).collect()
    assert [str(r.sold_date)[:10] for r in out] == ["2020-01-01", "None", "None", "2020-02-03", "2020-02-03"]
    assert [r.hours for r in out] == [None, 0.0, 100000.0, None, None]
    assert [r.year for r in out] == [None, 1950.0, 2003.0, None, None]
    assert [r.region for r in out] == ["mid\twest", None, None, None, "a"]
    assert [r.state for r in out] == ["IA", None, "TX", None, "B"]
    assert [r.make_key for r in out] == ["john-deere", None, "x", None, "c"]
    assert [r.make_model_key for r in out] == [None, "x-1", None, None, "d"]
    counted = invalid_price_count(clean_auctions(df, 2002)).first()
    assert (counted.n_rows, counted.n_invalid) == (5, 3)


def test_absent_columns_are_left_alone(spark):
    df = spark.createDataFrame([("5", "x")], "price string, other string")
    assert clean_auctions(df, 2002).columns == ["price", "other"]


def test_request_keys_and_defaults(spark):
    df = spark.createDataFrame(
        [("ford", "F 150_X", 2000, 10, None), ("ford", "(Any Model)", 2000, 10, "Fair"), ("ford", None, 2000, 10, None)],
        "make string, model string, year int, hours int, condition string")
    df = df.withColumns({"region": F.lit("midwest"), "category": F.lit("Tractor")})
    assert one(df.select(request_model_key(F.col("make"), F.col("model")))) == ["ford-f-150-x", "ford-na", "ford-na"]
    out = prepare_requests(df, "2002-01-01").collect()
    assert [r.raw_model for r in out] == ["F 150_X", "Unknown", "Unknown"]
    assert [r.raw_condition for r in out] == ["Good", "Fair", "Good"]
    assert (out[0].barometer, out[0].diesel_price, out[0].capital_investment_index) == (100.0, 3.5, 80.0)
    assert out[0].make_production_year_end is None


def test_request_validation(spark):
    df = spark.createDataFrame([(1980.0, 0.0, "Good", 50.0, 1.0), (2004.0, 1.0, "Good", 100.0, 3.0),
                                (None, 1.0, "Salvage", 201.0, 0.5)],
                               "year double, hours double, raw_condition string, barometer double, diesel_price double")
    out = validate_requests(df, 2002).collect()
    assert [r.is_valid for r in out] == [1, 0, 0]
    assert [r.ok_condition for r in out] == [1, 1, 0]
