import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lotvalue.operators import features as f
from lotvalue.operators.impute import cascade_horsepower, horsepower_medians

DAY = dt.datetime(2020, 6, 15)


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_bands_are_closed_above_and_zero_is_in_none(spark):
    df = spark.createDataFrame([(h,) for h in (0.0, 0.1, 300.0, 300.1, 600.0, 1000.0, 1000.1, 2000.0, None)], "h double")
    assert one(df, f.utilization_bucket(F.col("h"))) == [
        None, "light", "light", "normal", "normal", "heavy", "extreme", "extreme", "normal"]


def test_age_and_hours_per_year(spark):
    df = spark.createDataFrame([(DAY, 2021.0, 900.0), (DAY, 2020.0, 3000.0), (DAY, 1960.0, 100.0), (DAY, None, 5000.0),
                                (DAY, 2010.0, None), (DAY, 2010.0, 5000.0)], "sold_date timestamp_ntz, year double, hours double")
    out = f.add_age_and_use(df).collect()
    assert [r.equipment_age for r in out] == [0.0, 0.0, 50.0, None, 10.0, 10.0]
    assert [r.hours_per_year for r in out] == [900.0, 2000.0, 2.0, 2000.0, None, 500.0]


def test_existing_hours_per_year(spark):
    ddl = "sold_date timestamp_ntz, year double, hours double, hours_per_year double"
    some = spark.createDataFrame([(DAY, 2010.0, 5000.0, 42.0), (DAY, 2010.0, 5000.0, None)], ddl)
    none = spark.createDataFrame([(DAY, 2010.0, 5000.0, None)], ddl)
    assert one(f.add_age_and_use(some), "hours_per_year") == [42.0, None]
    assert one(f.add_age_and_use(none), "hours_per_year") == [500.0]
    derive = f.FeatureConfig(hours_per_year="derive")
    assert one(f.add_age_and_use(some, derive), "hours_per_year") == [500.0, 500.0]


def test_production_status(spark):
    df = spark.createDataFrame([(DAY, 2000), (DAY, 2030), (DAY, None)], "sold_date timestamp_ntz, make_production_year_end int")
    out = f.add_production_status(df).collect()
    assert [(r.is_current_production, r.years_since_discontinued) for r in out] == [(0, 20.0), (0, 0.0), (1, 0.0)]
    bare = f.add_production_status(df.select("sold_date")).first()
    assert (bare.is_current_production, bare.years_since_discontinued) == (1, 0.0)


def test_temporal(spark):
    row = f.add_temporal(spark.createDataFrame([(DAY,)], "sold_date timestamp_ntz")).first()
    assert (row.sale_month, row.sale_quarter, row.sale_year) == (6, 2, 2020)
    assert row.month_sin == pytest.approx(math.sin(math.pi)) and row.month_cos == pytest.approx(-1)
    assert (row.is_planting_season, row.is_harvest_season) == (0, 0)


def test_macro_statistics_rules(spark):
    df = spark.createDataFrame([(120.0, 4.0)], "barometer double, diesel_price double")
    assert f.add_macro(df, {}).first().asDict() == {
        "barometer": 120.0, "diesel_price": 4.0, "barometer_norm": 1.0, "diesel_relative": pytest.approx(4 / 3.5)}
    flat = f.add_macro(df, {"barometer_mean": 100.0, "barometer_std": 0.0, "diesel_mean": 0.0})
    assert flat.first().barometer_norm == 0.0 and "diesel_relative" not in flat.columns
    unknown = f.add_macro(df, {"barometer_mean": None, "barometer_std": None, "diesel_mean": None})
    assert unknown.first().barometer_norm == 0.0 and "diesel_relative" not in unknown.columns


def test_specs(spark):
    cells = ['{"horsepower"=>455, "x"=>nil}', '{"horsepower"=>"455"}', '{"horsepower"=>"455hp"}', '{"horsepower"=>nil}',
             "{bad", "", None, "[1]", "7", '{"drive"=>"4 Wheel", "features"=>["Cab", "Tractor"], "attachments"=>["a"]}']
    df = spark.createDataFrame([(c,) for c in cells], "specs string")
    assert one(df, f.parsed_horsepower(F.col("specs"))) == [455.0, 455.0, None, None, None, None, None, None, None, None]
    last = f.spec_flags(df).collect()[-1]
    assert (last.drive_type, last.is_4wd, last.has_cab, last.has_gps, last.has_ac, last.num_attachments) == (
        "4 wheel", 1, 1, 0, 1, 1)          # 'ac' is inside 'tractor'
    first = f.spec_flags(df).first()
    assert (first.drive_type, first.is_4wd, first.has_cab, first.num_attachments) == ("", 0, 0, 0)


def test_horsepower_category_median_is_taken_after_the_model_fill(spark):
    rows = [("m1", "c", 100.0), ("m1", "c", None), ("m1", "c", None), ("m2", "c", 300.0), ("m3", "c", None), (None, "d", None)]
    df = spark.createDataFrame(rows, "make_model_key string, raw_category string, horsepower double")
    medians, n = horsepower_medians(df)
    out = cascade_horsepower(df, medians, n, 150.0)
    got = sorted((r.make_model_key or "", r.horsepower) for r in out.collect())
    assert got == [("", 150.0), ("m1", 100.0), ("m1", 100.0), ("m1", 100.0), ("m2", 300.0), ("m3", 100.0)]


def training_rows(spark):
    rows = []
    for key, n in (("a", 19), ("b", 20), ("c", 21)):
        rows += [(DAY, 2010.0, 100.0, key, "r", "cat", "Model " + key, 100.0 + n, 3.0, '{"horsepower"=>%d}' % (100 + n))] * n
    rows.append((DAY, 2010.0, 100.0, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, "sold_date timestamp_ntz, year double, hours double, make_model_key string, region string, "
                                       "raw_category string, raw_model string, barometer double, diesel_price double, specs string")


def test_rare_levels_and_volumes(spark):
    df = training_rows(spark)
    fitted = f.FeaturePipeline().fit(df)
    out = fitted.transform(df)
    got = {(r.make_model_key, r.region, r.make_volume, r.model_volume) for r in out.collect()}
    assert got == {("other", "r", 19, 19), ("b", "r", 20, 20), ("c", "r", 21, 21), ("other", "other", 1, 1)}
    again = fitted.add_levels(out.drop("make_volume", "model_volume", "log_make_volume", "log_model_volume"))
    assert {r.make_model_key for r in again.select("make_model_key").distinct().collect()} == {"other", "b", "c"}
    assert {(r.feature, r.level) for r in fitted.valid_levels().collect()} == {
        ("make_model_key", "b"), ("make_model_key", "c"), ("region", "r"), ("raw_category", "cat")}
    assert set(f.NUMERIC) - set(out.columns) == {"sentiment_spread", "investment_confidence", "el_nino_phase"}


def test_unseen_level_and_no_model_column(spark):
    fitted = f.FeaturePipeline().fit(training_rows(spark).drop("raw_model", "specs"))
    new = training_rows(spark).limit(1).withColumn("make_model_key", F.lit("zzz")).drop("raw_model", "specs")
    row = fitted.transform(new).first()
    assert (row.make_model_key, row.make_volume, row.log_model_volume, row.horsepower) == ("other", 1, 0.0, 150.0)


def test_batch_and_fitted_horsepower_scopes_and_storage(spark, tmp_path):
    df = training_rows(spark)
    fitted = f.FeaturePipeline(f.FeatureConfig(horsepower_scope="fitted")).fit(df)
    request = df.filter("make_model_key = 'c'").limit(1).withColumn("specs", F.lit(None).cast("string"))
    assert fitted.transform(request).first().horsepower == 121.0
    assert f.FeaturePipeline().fit(df).transform(request).first().horsepower == 150.0
    fitted.save(str(tmp_path / "p"))
    loaded = f.FittedFeatures.load(spark, str(tmp_path / "p"))
    assert loaded.config == fitted.config and loaded.stats == fitted.stats
    assert loaded.transform(request).first() == fitted.transform(request).first()


def test_model_volume_by_make(spark):
    df = spark.createDataFrame([("a", "m"), ("a", "m"), ("b", "m"), (None, "m")], "make_key string, raw_model string")
    assert sorted(r.model_volume for r in f.model_volume_by_make(df).collect()) == [0, 1, 2, 2]


def test_absent_columns_skip_their_level(spark):
    df = spark.createDataFrame([("m", 100.0), ("m", None), ("x", None)], "make_model_key string, horsepower double")
    medians, n = horsepower_medians(df)
    assert sorted(r.horsepower for r in cascade_horsepower(df, medians, n, 150.0).collect()) == [100.0, 100.0, 150.0]
    df = spark.createDataFrame([("c", 80.0), ("c", None)], "raw_category string, horsepower double")
    medians, n = horsepower_medians(df)
    assert [r.horsepower for r in cascade_horsepower(df, medians, n, 150.0).collect()] == [80.0, 80.0]
    ends = spark.createDataFrame([(1996,), (None,)], "make_production_year_end int")
    out = f.add_production_status(ends)
    assert [r.is_current_production for r in out.collect()] == [0, 1] and "years_since_discontinued" not in out.columns


def test_keys_lose_all_white_space(spark):
    from lotvalue.functions.columns import text_key
    df = spark.createDataFrame([("John-Deere\xa0",), ("\u3000Ford\x1f",), ("\u2009nan\x85",)], "k string")
    assert [r[0] for r in df.select(text_key(F.col("k"))).collect()] == ["john-deere", "ford", None]
