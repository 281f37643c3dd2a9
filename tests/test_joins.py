import datetime as dt

from pyspark.sql import functions as F

from lotvalue.operators import joins


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lookup_join_gives_the_same_rows_either_way(spark):
    fact = (spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
                                         .otherwise(F.concat(F.lit("k"), F.col("id") % 400))))
    table = fact.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    n = table.count()
    small = joins.lookup_join(fact, table, ["k"], n, "n")
    large = joins.lookup_join(fact, table, ["k"], n, "n", max_broadcast=0)
    plain = joins.lookup_join(fact, table, ["k"], n, max_broadcast=0)
    expected = rows(small, "id", "k", "n", "top")
    assert rows(large, "id", "k", "n", "top") == expected
    assert rows(plain, "id", "k", "n", "top") == expected
    assert large.count() == 3000


def test_hot_key_is_spread(spark):
    fact = spark.range(4000).withColumn("k", F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")))
    table = fact.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.lookup_join(fact, table, ["k"], 1001, "n", max_broadcast=0)
        sizes = [r[0] for r in joined.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 3000 and len(sizes) == 4 and max(sizes) < 1500


def test_duplicate_months_multiply_lots(spark):
    lots = spark.createDataFrame([(1, dt.datetime(2020, 3, 5)), (2, dt.datetime(2020, 4, 1))], "id int, sold_date timestamp_ntz")
    barometer = spark.createDataFrame([(dt.datetime(2020, 3, 1), 1.0), (dt.datetime(2020, 3, 20), 2.0)],
                                      "date timestamp_ntz, barometer double")
    diesel = spark.createDataFrame([(dt.datetime(2020, 3, 2), 3.0), (dt.datetime(2020, 3, 9), 4.0)],
                                   "month_date timestamp_ntz, price_usd_per_gallon double")
    el_nino = spark.createDataFrame([(2020, 4, 0.1, 2.0)], "year int, month int, value double, phase double")
    out = joins.join_macro(lots, barometer, diesel, el_nino)
    assert rows(out, "id", "barometer", "diesel_price", "el_nino_phase") == sorted([
        (1, 1.0, 3.0, None), (1, 1.0, 4.0, None), (1, 2.0, 3.0, None), (1, 2.0, 4.0, None), (2, None, None, 2.0)], key=repr)


def test_series_without_its_key_is_skipped(spark):
    lots = spark.createDataFrame([(1, dt.datetime(2020, 3, 5))], "id int, sold_date timestamp_ntz")
    odd = spark.createDataFrame([(1.0,)], "barometer double")
    assert joins.join_macro(lots, barometer=odd).columns == ["id", "sold_date", "month_key"]


def test_futures_names_and_means(spark):
    futures = spark.createDataFrame([(dt.datetime(2020, 3, 5), "Live Cattle", 1.0), (dt.datetime(2020, 3, 6), "Live Cattle", 3.0),
                                     (dt.datetime(2020, 3, 6), "Corn", 5.0), (None, "Corn", 9.0)],
                                    "date timestamp_ntz, future_symbol string, price double")
    assert joins.list_symbols(futures) == ["Corn", "Live Cattle"]
    out = joins.futures_by_month(futures, joins.list_symbols(futures))
    assert [tuple(r) for r in out.collect()] == [(dt.date(2020, 3, 1), 5.0, 2.0)]
    assert out.columns == ["month_key", "corn_price", "live_cattle_price"]


def test_makes_join_and_duplicates(spark):
    lots = spark.createDataFrame([("ford",), ("x",), (None,)], "make_key string")
    makes = spark.createDataFrame([("Ford", " FORD ", True, 1999)], "name string, make_key string, still_in_business boolean, production_year_end int")
    out = joins.join_makes(lots, makes)
    assert rows(out, "make_key", "make_name", "make_production_year_end") == sorted(
        [("ford", "Ford", 1999), ("x", None, None), (None, None, None)], key=repr)
    assert joins.duplicate_keys(makes.union(makes), "make_key").first().n == 2
    assert joins.match_counts(out, {"makes": "make_name"}).first().n_makes == 1
