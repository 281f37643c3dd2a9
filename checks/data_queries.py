"""Registered queries over scans, cleaning, filters, joins, imputation and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotvalue.functions.columns import coerce_number
from lotvalue.functions.rules import CATEGORY_RULES, category_memberships, category_name, category_key
from lotvalue.operators import cleaning, features, filters, impute, joins, profiling
from lotvalue.plans import datasets
from lotvalue.sources import roles

from . import inputs as i
from .registry import query
from .sql import (
    AS_OF, AS_OF_YEAR, BY_CATEGORY, CATEGORY_KEY, COMPLETE, CTES, HIGH, HP_TEXT, KEYS, KEY_SPEC, LOW,
    MAKE_CATEGORY_KEY, MIN_DATE, MONTH, PRICE_COLUMNS, WS, _any, _key, coverage_rows, funnel_rows, missing_rows,
)

RULE = {r.key: r for r in CATEGORY_RULES}
BASE = ["sold_date", "price", "hours", "year", "make_key", "make_model_key", "raw_model", "raw_category",
        "raw_condition", "region", "state"]

CLEAN_SPEC = (KEY_SPEC + ", sold_date:d, price:f4, hours:f2, year:f1, region:s, state:s, make_key:s, "
              "make_model_key:s")


@query("clean_auctions", CLEAN_SPEC, "SELECT * FROM clean")
def clean_auctions(spark, d):
    return i.clean(spark, d, *i.ID, "sold_date", "price", "hours", "year", "region", "state", "make_key",
                   "make_model_key")


@query("parse_text_prices", "raw_price:s, parsed:f2, n_rows:i",
       f"SELECT raw_price, TRY_CAST(trim(raw_price, {WS}) AS double) AS parsed, count(*) AS n_rows FROM raw_lots GROUP BY ALL")
def parse_text_prices(spark, d):
    lots = i.raw(spark, d, "raw_price")
    return lots.groupBy("raw_price", coerce_number(F.col("raw_price"), "string").alias("parsed")).agg(
        F.count("*").alias("n_rows"))


@query("invalid_price_count", "n_rows:i, n_invalid:i",
       "SELECT count(*) AS n_rows, count(*) FILTER (price <= 0 OR price IS NULL) AS n_invalid FROM clean")
def invalid_price_count(spark, d):
    return cleaning.invalid_price_count(i.clean(spark, d, "price"))


@query("standardise_keys", "make_key:s, region:s, state:s, n_rows:i",
       "SELECT make_key, region, state, count(*) AS n_rows FROM clean GROUP BY ALL")
def standardise_keys(spark, d):
    return i.clean(spark, d, "make_key", "region", "state").groupBy("make_key", "region", "state").agg(
        F.count("*").alias("n_rows"))


@query("standardise_makes", "make_key:s, name:s, production_year_end:i",
       f"SELECT lower(trim(make_key, {WS})) AS make_key, name, production_year_end FROM makes")
def standardise_makes(spark, d):
    return cleaning.standardise_makes(roles.makes(spark, d))


@query("union_parts", "part_no:i, n_rows:i, n_hours:i", """
    SELECT part_no, count(*) AS n_rows, count(hours) AS n_hours FROM (
        SELECT 1 AS part_no, hours FROM raw_lots WHERE lot_line <= 3
        UNION ALL SELECT 2, NULL FROM raw_lots WHERE lot_line > 3) AS t GROUP BY ALL""")
def union_parts(spark, d):
    """Parts are united by name; the second part has no hours column."""
    lots = i.raw(spark, d, "lot_line", "hours")
    first = lots.filter("lot_line <= 3").withColumn("part_no", F.lit(1))
    second = lots.filter("lot_line > 3").drop("hours").withColumn("part_no", F.lit(2))
    return first.unionByName(second, allowMissingColumns=True).groupBy("part_no").agg(
        F.count("*").alias("n_rows"), F.count("hours").alias("n_hours"))


@query("auctioneers", "s_suppkey:i, s_name:s", "SELECT s_suppkey, s_name FROM supplier")
def auctioneers(spark, d):
    return roles.table(spark, d, "supplier")


@query("future_symbols", "future_symbol:s", "SELECT DISTINCT future_symbol FROM futures")
def future_symbols(spark, d):
    from lotvalue.sources.readers import future_symbols as symbols
    return symbols(roles.futures(spark, d))


# -- filters ---------------------------------------------------------------------------------------------------

@query("filter_training", KEY_SPEC + ", sold_date:d, price:f4, make_key:s",
       f"SELECT {KEYS}, sold_date, price, make_key FROM lots")
def filter_training(spark, d):
    return i.lots(spark, d, *i.ID)


@query("filter_date_range", KEY_SPEC + ", sold_date:d",
       f"SELECT * FROM raw_lots WHERE sold_date BETWEEN '{MIN_DATE}' AND '1998-06-30' AND price BETWEEN 1000 AND 2000000")
def filter_date_range(spark, d):
    return filters.filter_training(i.clean(spark, d, *i.ID, "sold_date", "price"), min_date=MIN_DATE,
                                   max_date="1998-06-30")


FUNNEL = [("price", f"price BETWEEN {LOW} AND {HIGH}"), ("min_date", f"sold_date >= '{MIN_DATE}'"),
          ("has_price", "price IS NOT NULL"), ("has_make_key", "make_key IS NOT NULL"),
          ("has_year", "year IS NOT NULL"), ("has_hours", "hours IS NOT NULL")]


@query("funnel", "step_no:i, step:s, rows_left:i, rows_removed:i", funnel_rows("clean", FUNNEL))
def funnel(spark, d):
    lots = i.clean(spark, d, "price", "sold_date", "make_key", "year", "hours")
    steps = filters.training_steps(lots, LOW, HIGH, MIN_DATE, require=["price", "make_key", "year", "hours", "absent"])
    return filters.funnel(lots, steps)


@query("category_filter", KEY_SPEC + ", raw_category:s, price:f4",
       f"SELECT * FROM clean WHERE {_any('raw_category', ['tractor'])} AND price BETWEEN 5000 AND 500000")
def category_filter(spark, d):
    return filters.filter_category(i.clean(spark, d, *i.ID, "raw_category", "price"), RULE["tractors"])


@query("make_filter", KEY_SPEC + ", make_key:s", "SELECT * FROM clean WHERE make_key = 'john-deere'")
def make_filter(spark, d):
    return i.clean(spark, d, *i.ID, "make_key").filter(F.col("make_key") == "john-deere")


@query("other_segment", KEY_SPEC + ", raw_category:s, price:f4, make_key:s", f"""
    SELECT * FROM clean WHERE {CATEGORY_KEY} = 'other' AND price BETWEEN 1000 AND 500000 AND sold_date >= '{MIN_DATE}'
    AND make_key IS NOT NULL AND year IS NOT NULL AND hours IS NOT NULL AND region IS NOT NULL""")
def other_segment(spark, d):
    return datasets.other_lots(i.clean(spark, d, *i.ID, *BASE), MIN_DATE)


@query("record_gate", "category_key:s, n_records:i, trainable:i",
       "SELECT *, CASE WHEN n_records >= 1000 THEN 1 ELSE 0 END AS trainable FROM ("
       + " UNION ALL ".join(f"SELECT '{k}' AS category_key, count(*) AS n_records FROM lots WHERE "
                            f"{_any('raw_category', t)}" for k, t in BY_CATEGORY.items()) + ") AS t")
def record_gate(spark, d):
    members = i.lots(spark, d, "raw_category").select(
        F.explode(category_memberships(F.col("raw_category"))).alias("category_key"))
    return filters.record_gate(members, ["category_key"], 1000)


@query("make_category_gate", "make_category_key:s, n_records:i, trainable:i", f"""
    SELECT k AS make_category_key, coalesce(n, 0) AS n_records, CASE WHEN coalesce(n, 0) >= 150 THEN 1 ELSE 0 END AS trainable
    FROM (VALUES ('john-deere_tractors'), ('john-deere_harvesting'), ('john-deere_planting'),
        ('john-deere_hay_forage'), ('ford_trucks'), ('ford_tractors'), ('case-ih_tractors'), ('case-ih_harvesting'),
        ('chevrolet_trucks'), ('new-holland_tractors'), ('new-holland_hay_forage')) AS v(k)
    LEFT JOIN (SELECT {MAKE_CATEGORY_KEY} AS mk, count(*) AS n FROM lots GROUP BY 1) AS c ON c.mk = v.k""")
def make_category_gate(spark, d):
    return filters.trainable_make_categories(i.lots(spark, d, "raw_category"), min_records=150)


@query("complete_records", KEY_SPEC, f"SELECT {KEYS} FROM clean WHERE {COMPLETE}")
def complete_records(spark, d):
    return filters.require_complete(i.clean(spark, d, *i.ID, *BASE))


@query("recent_usable", KEY_SPEC + ", sold_date:d",
       f"SELECT * FROM clean WHERE price > 0 AND sold_date IS NOT NULL AND make_key IS NOT NULL "
       f"AND sold_date >= cast('{AS_OF}' AS date) - INTERVAL 7 YEAR")
def recent_usable(spark, d):
    lots = i.clean(spark, d, *i.ID, "price", "sold_date", "make_key")
    return lots.filter(filters.usable() & filters.recent(AS_OF))


@query("quality_summary", "check_name:s, n_rows:i, pct:f4", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS check_name, count(*) FILTER ({c}) AS n_rows, "
    f"avg(CASE WHEN {c} THEN 1.0::double ELSE 0 END) * 100 AS pct FROM clean" for n, c in {
        "total": "true", "has_price": "price > 0", "has_sold_date": "sold_date IS NOT NULL",
        "has_year": "year IS NOT NULL", "has_hours": "hours IS NOT NULL", "has_make_key": "make_key IS NOT NULL",
        "has_model_id": "model_id IS NOT NULL", "has_region": "region IS NOT NULL",
        "has_condition": "raw_condition IS NOT NULL", "has_category": "raw_category IS NOT NULL",
        "usable": "price > 0 AND sold_date IS NOT NULL AND make_key IS NOT NULL",
        "usable_recent": f"price > 0 AND make_key IS NOT NULL AND sold_date >= cast('{AS_OF}' AS date) - INTERVAL 7 YEAR",
    }.items()) + ") AS q")
def quality_summary(spark, d):
    return filters.quality_summary(i.clean(spark, d, "price", "sold_date", "year", "hours", "make_key", "model_id",
                                           "region", "raw_condition", "raw_category"), AS_OF)


# -- joins -----------------------------------------------------------------------------------------------------

MAKE_SPEC = "make_name:s, make_still_in_business:i, make_country:s, make_production_year_end:i"


@query("join_makes", KEY_SPEC + ", make_key:s, " + MAKE_SPEC,
       "SELECT lots.*, makes_dim.* EXCLUDE (make_key) FROM lots LEFT JOIN makes_dim ON lots.make_key = makes_dim.make_key")
def join_makes(spark, d):
    return joins.join_makes(i.lots(spark, d, *i.ID), roles.makes(spark, d))


@query("duplicate_keys", "make_key:s, n:i",
       "SELECT p_brand AS make_key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return joins.duplicate_keys(roles.table(spark, d, "part").withColumnRenamed("p_brand", "make_key"), "make_key")


@query("join_barometer", KEY_SPEC + ", barometer:f4, current_conditions:f4, future_expectations:f4, "
                                    "capital_investment_index:f4",
       f"SELECT * FROM lots LEFT JOIN barometer AS b ON b.date = {MONTH}")
def join_barometer(spark, d):
    return joins.join_macro(i.lots(spark, d, *i.ID), barometer=roles.barometer(spark, d))


@query("join_diesel", KEY_SPEC + ", diesel_price:f4",
       f"SELECT lots.*, price_usd_per_gallon AS diesel_price FROM lots LEFT JOIN diesel ON month_date = {MONTH}")
def join_diesel(spark, d):
    return joins.join_macro(i.lots(spark, d, *i.ID), diesel=roles.diesel(spark, d))


@query("join_el_nino", KEY_SPEC + ", el_nino_value:f3, el_nino_phase:f1",
       f"SELECT lots.*, value AS el_nino_value, phase AS el_nino_phase FROM lots LEFT JOIN el_nino AS e "
       f"ON make_date(e.year, e.month, 1) = {MONTH}")
def join_el_nino(spark, d):
    return joins.join_macro(i.lots(spark, d, *i.ID), el_nino=roles.el_nino(spark, d))


@query("futures_monthly_mean", "month_key:d, future_symbol:s, mean_price:f3", "SELECT * FROM futures_mean")
def futures_monthly_mean(spark, d):
    return joins.futures_monthly_mean(roles.futures(spark, d))


WIDE_SPEC = ", ".join(f"{c}:f3" for c in PRICE_COLUMNS)


@query("futures_pivot", "month_key:d, " + WIDE_SPEC, "SELECT * FROM futures_wide")
def futures_pivot(spark, d):
    return joins.futures_by_month(roles.futures(spark, d), roles.FUTURE_SYMBOLS)


MACRO_SPEC = ("month_key:d, barometer:f4, current_conditions:f4, future_expectations:f4, capital_investment_index:f4, "
              "diesel_price:f4, el_nino_value:f3, el_nino_phase:f1, " + WIDE_SPEC)


@query("macro_calendar", MACRO_SPEC, """
    SELECT b.date AS month_key, b.* EXCLUDE (date), d.price_usd_per_gallon AS diesel_price, e.value AS el_nino_value,
        e.phase AS el_nino_phase, f.* EXCLUDE (month_key)
    FROM barometer AS b JOIN diesel AS d ON b.date = d.month_date
    JOIN el_nino AS e ON make_date(e.year, e.month, 1) = b.date JOIN futures_wide AS f ON f.month_key = b.date""")
def macro_calendar(spark, d):
    return joins.macro_calendar(roles.barometer(spark, d), roles.diesel(spark, d), roles.el_nino(spark, d),
                                roles.futures(spark, d), roles.FUTURE_SYMBOLS)


@query("join_macro", KEY_SPEC + ", " + MACRO_SPEC, "SELECT * FROM training")
def join_macro(spark, d):
    return joins.join_macro(i.lots(spark, d, *i.ID), roles.barometer(spark, d), roles.diesel(spark, d),
                            roles.el_nino(spark, d), roles.futures(spark, d), roles.FUTURE_SYMBOLS)


@query("match_counts", "n_rows:i, n_makes:i, n_barometer:i, n_diesel:i, n_el_nino:i, n_futures:i", """
    SELECT count(*) AS n_rows, count(make_name) AS n_makes, count(barometer) AS n_barometer,
        count(diesel_price) AS n_diesel, count(el_nino_phase) AS n_el_nino, count(high_price) AS n_futures
    FROM training""")
def match_counts(spark, d):
    return joins.match_counts(i.training(spark, d), {
        "makes": "make_name", "barometer": "barometer", "diesel": "diesel_price", "el_nino": "el_nino_phase",
        "futures": "high_price"})


TRAINING_SPEC = (CLEAN_SPEC + ", raw_category:s, raw_condition:s, " + MAKE_SPEC + ", " + MACRO_SPEC)


@query("training_dataset", TRAINING_SPEC, "SELECT * FROM training")
def training_dataset(spark, d):
    return i.training(spark, d, *i.ID, *BASE)


def _enriched(condition: str) -> str:
    return (f"SELECT c.*, makes_dim.* EXCLUDE (make_key), b.* EXCLUDE (date), d.price_usd_per_gallon AS diesel_price "
            f"FROM (SELECT * FROM clean WHERE {condition}) AS c LEFT JOIN makes_dim ON c.make_key = makes_dim.make_key "
            f"LEFT JOIN barometer AS b ON b.date = {MONTH} LEFT JOIN diesel AS d ON d.month_date = {MONTH}")


SEGMENT_SPEC = KEY_SPEC + ", sold_date:d, price:f4, make_model_key:s, make_name:s, barometer:f4, diesel_price:f4"


@query("category_dataset", SEGMENT_SPEC, _enriched(
    f"sold_date >= '{MIN_DATE}' AND {_any('raw_category', BY_CATEGORY['harvesting'])} "
    f"AND price BETWEEN 5000 AND 600000 AND {COMPLETE}"))
def category_dataset(spark, d):
    lots = datasets.category_lots(i.clean(spark, d, *i.ID, *BASE), RULE["harvesting"], MIN_DATE)
    return datasets.enrich(lots, roles.catalog(spark, d, ["lot_order"]), roles.FUTURE_SYMBOLS)


@query("make_category_dataset", SEGMENT_SPEC, _enriched(
    f"sold_date >= '{MIN_DATE}' AND make_key = 'john-deere' AND {_any('raw_category', BY_CATEGORY['harvesting'])} "
    f"AND price BETWEEN 5000 AND 500000 AND {COMPLETE}"))
def make_category_dataset(spark, d):
    lots = datasets.make_category_lots(i.clean(spark, d, *i.ID, *BASE), "john-deere", "harvesting", MIN_DATE)
    return datasets.enrich(lots, roles.catalog(spark, d, ["lot_order"]), roles.FUTURE_SYMBOLS)


# -- imputation ------------------------------------------------------------------------------------------------

IMPUTE_COLUMNS = ["sold_date", "price", "year", "hours", "make_model_key", "raw_category", "region", "make_key"]


@query("impute_year_hours", KEY_SPEC + ", year:f1, hours:f2, hours_by_model:f2, hours_by_category:f2",
       "SELECT * FROM imputed")
def impute_year_hours(spark, d):
    lots = i.raw(spark, d, *i.ID, "sold_date", "year", "hours", "make_model_key", "raw_category")
    return impute.impute_hours(impute.impute_year(lots), keep_parts=True)


@query("group_median", KEY_SPEC + ", hours:f2, category_median:f2",
       "SELECT *, median(hours) OVER (PARTITION BY raw_category) AS category_median FROM raw_lots "
       "WHERE raw_category IS NOT NULL UNION ALL SELECT *, NULL FROM raw_lots WHERE raw_category IS NULL")
def group_median(spark, d):
    return impute.group_median_column(i.raw(spark, d, *i.ID, "hours", "raw_category"), "raw_category", "hours",
                                      "category_median")


@query("imputed_dataset", KEY_SPEC + ", price:f4, year:f1, hours:f2, make_model_key:s, region:s", f"""
    SELECT * FROM imputed_clean WHERE sold_date >= '{MIN_DATE}' AND {_any('raw_category', BY_CATEGORY['harvesting'])}
    AND price BETWEEN 5000 AND 600000 AND make_model_key IS NOT NULL AND region IS NOT NULL""")
def imputed_dataset(spark, d):
    return datasets.imputed_lots(i.raw(spark, d, *i.ID, *IMPUTE_COLUMNS), RULE["harvesting"], AS_OF_YEAR, MIN_DATE)


@query("imputed_training_dataset", KEY_SPEC + ", price:f4, year:f1, hours:f2, make_model_key:s, region:s, make_name:s, barometer:f4, "
       "diesel_price:f4, el_nino_phase:f1", _enriched(
    f"sold_date >= '{MIN_DATE}' AND {_any('raw_category', BY_CATEGORY['harvesting'])} AND price BETWEEN 5000 AND 600000 "
    "AND make_model_key IS NOT NULL AND region IS NOT NULL").replace("FROM clean WHERE", "FROM imputed_clean WHERE").replace(
    "AS diesel_price FROM", "AS diesel_price, e.phase AS el_nino_phase FROM")
    + f" LEFT JOIN el_nino AS e ON make_date(e.year, e.month, 1) = {MONTH}")
def imputed_training_dataset(spark, d):
    catalog = roles.catalog(spark, d, [*i.ID, *IMPUTE_COLUMNS])
    return datasets.imputed_dataset(catalog, RULE["harvesting"], AS_OF_YEAR, roles.FUTURE_SYMBOLS, MIN_DATE)


@query("imputed_coverage", "field:s, coverage_pct:f4", coverage_rows("imputed_clean", ["year", "hours"]))
def imputed_coverage(spark, d):
    return impute.coverage(impute.clean_with_imputation(i.raw(spark, d, *IMPUTE_COLUMNS), AS_OF_YEAR),
                           ["year", "hours"])


@query("field_coverage", "field:s, coverage_pct:f4",
       coverage_rows("training", ["price", "year", "hours", "make_key", "region", "barometer", "diesel_price",
                                  "el_nino_phase"]))
def field_coverage(spark, d):
    return impute.coverage(i.training(spark, d, "price", "year", "hours", "region"),
                           ["price", "year", "hours", "make_key", "region", "barometer", "diesel_price",
                            "el_nino_phase"])


@query("hours_by_make_age", KEY_SPEC + ", equipment_age:f1, hours:f2, hours_make_age:f2, hours_imputed:f2", f"""
    SELECT t.*, h AS hours_make_age, coalesce(hours, h) AS hours_imputed FROM (
        SELECT *, CASE WHEN year IS NOT NULL THEN least(greatest(year(sold_date) - year, 0), 50) END AS equipment_age FROM lots) AS t
    LEFT JOIN (SELECT make_key AS mk, least(greatest(year(sold_date) - year, 0), 50) AS ag, median(hours) AS h
        FROM lots WHERE year IS NOT NULL GROUP BY ALL) AS m ON m.mk = t.make_key AND m.ag = t.equipment_age""")
def hours_by_make_age(spark, d):
    aged = features.add_age_and_use(i.lots(spark, d, *i.ID, "hours", "year"))
    return impute.hours_by_make_and_age(aged)


# -- features --------------------------------------------------------------------------------------------------

@query("specs_horsepower", KEY_SPEC + ", horsepower:f2", f"""
    SELECT *, TRY_CAST({HP_TEXT} AS double) AS horsepower FROM (
        SELECT *, CASE WHEN json_valid(j) THEN j END AS specs_json FROM (
            SELECT *, replace(replace(specs, '=>', ':'), 'nil', 'null') AS j FROM raw_lots) AS a) AS b""")
def specs_horsepower(spark, d):
    return i.raw(spark, d, *i.ID, "specs").withColumn("horsepower", features.parsed_horsepower(F.col("specs")))


@query("horsepower_cascade", KEY_SPEC + ", horsepower:f3", "SELECT * FROM hp2")
def horsepower_cascade(spark, d):
    lots = i.lots(spark, d, *i.ID, "specs", "make_model_key", "raw_category")
    parsed = lots.withColumn("horsepower", features.parsed_horsepower(F.col("specs")))
    medians, n = impute.horsepower_medians(parsed)
    return impute.cascade_horsepower(parsed, medians, n, features.DEFAULT_HORSEPOWER)


@query("condition_features", KEY_SPEC + ", raw_condition:s, condition:s, condition_score:f1", "SELECT * FROM equipped")
def condition_features(spark, d):
    return features.add_condition(i.lots(spark, d, *i.ID, "raw_condition"))


@query("equipment_features", KEY_SPEC + ", equipment_age:f1, hours_per_year:f4, utilization_bucket:s, "
       "is_current_production:i, years_since_discontinued:f1, condition:s", "SELECT * FROM equipped")
def equipment_features(spark, d):
    lots = i.lots(spark, d, *i.ID, "year", "hours", "raw_condition")
    return features.add_equipment(joins.join_makes(lots, roles.makes(spark, d)))


TEMPORAL_SPEC = ("sale_month:i, sale_quarter:i, sale_year:i, month_sin:f6, month_cos:f6, is_planting_season:i, "
                 "is_harvest_season:i")


@query("temporal_features", KEY_SPEC + ", " + TEMPORAL_SPEC, "SELECT * FROM features")
def temporal_features(spark, d):
    return features.add_temporal(i.lots(spark, d, *i.ID))


MACRO_FEATURES = "barometer_norm:f4, sentiment_spread:f4, investment_confidence:f4, diesel_relative:f4"


@query("macro_features", KEY_SPEC + ", " + MACRO_FEATURES, "SELECT * FROM features")
def macro_features(spark, d):
    data = i.stored_training(spark, d, *i.ID)
    stats = features.fit_statistics(data).first().asDict()
    return features.add_macro(data, stats)


@query("density_features", KEY_SPEC + ", make_volume:i, log_make_volume:f6, model_volume:i, log_model_volume:f6",
       "SELECT * FROM features")
def density_features(spark, d):
    data = i.lots(spark, d, *i.ID, "make_model_key", "raw_model", "region", "raw_category")
    return features.FeaturePipeline().fit(data).add_levels(data)


@query("rare_categories", "make_model_key:s, region:s, raw_category:s, n_rows:i",
       "SELECT make_model_key, region, raw_category, count(*) AS n_rows FROM features GROUP BY ALL")
def rare_categories(spark, d):
    data = i.lots(spark, d, "make_model_key", "region", "raw_category")
    out = features.FeaturePipeline().fit(data).add_levels(data)
    return out.groupBy("make_model_key", "region", "raw_category").agg(F.count("*").alias("n_rows"))


@query("features_all", KEY_SPEC + ", make_model_key:s, region:s, raw_category:s, condition:s, condition_score:f1, "
       "year:f1, hours:f2, equipment_age:f1, hours_per_year:f4, utilization_bucket:s, is_current_production:i, "
       "years_since_discontinued:f1, " + TEMPORAL_SPEC + ", " + MACRO_FEATURES + ", el_nino_phase:f1, "
       "log_make_volume:f6, log_model_volume:f6, horsepower:f3", "SELECT * FROM features")
def features_all(spark, d):
    return features.FeaturePipeline().fit_transform(i.stored_training(spark, d, *i.ID, *BASE, "specs"))


@query("fit_stats", "barometer_mean:f4, barometer_std:f4, diesel_mean:f4", "SELECT * FROM stats")
def fit_stats(spark, d):
    return features.fit_statistics(i.training(spark, d))


@query("frequency_table", "feature:s, level:s, n:i", "SELECT * FROM levels")
def frequency_table(spark, d):
    wanted = ["make_model_key", "region", "raw_category", "raw_model"]
    return features.frequency_table(i.lots(spark, d, *wanted), wanted)


@query("valid_keys", "feature:s, level:s, n:i",
       "SELECT * FROM levels WHERE n >= 20 AND feature <> 'raw_model'")
def valid_keys(spark, d):
    data = i.lots(spark, d, "make_model_key", "region", "raw_category")
    return features.FeaturePipeline().fit(data).valid_levels()


@query("utilization_counts", "utilization_bucket:s, n:i",
       "SELECT utilization_bucket, count(*) AS n FROM equipped WHERE utilization_bucket IS NOT NULL GROUP BY 1")
def utilization_counts(spark, d):
    return profiling.value_counts(features.add_age_and_use(i.lots(spark, d, "year", "hours")), "utilization_bucket")


MISSING = ["year", "hours", "equipment_age", "hours_per_year", "barometer_norm", "diesel_relative", "el_nino_phase",
           "horsepower", "condition_score"]


@query("missing_summary", "feature:s, missing_count:i, missing_pct:f1", missing_rows("features", MISSING))
def missing_summary(spark, d):
    data = i.stored_training(spark, d, "make_model_key", "raw_category", "raw_condition", "year", "hours", "specs")
    return profiling.missing_summary(features.FeaturePipeline().fit_transform(data), MISSING)


@query("spec_flags", KEY_SPEC + ", drive_type:s, is_4wd:i, has_cab:i, has_gps:i, has_ac:i, num_attachments:i", """
    SELECT *, lower(coalesce(dr, '')) AS drive_type, CASE WHEN contains(coalesce(dr, ''), '4') THEN 1 ELSE 0 END AS is_4wd,
        CASE WHEN contains(fs, 'cab') THEN 1 ELSE 0 END AS has_cab,
        CASE WHEN contains(fs, 'gps') OR contains(fs, 'guidance') THEN 1 ELSE 0 END AS has_gps,
        CASE WHEN contains(fs, 'ac') OR contains(fs, 'air') THEN 1 ELSE 0 END AS has_ac,
        coalesce(json_array_length(sj, '$.attachments'), 0) AS num_attachments
    FROM (SELECT *, json_extract_string(sj, '$.drive') AS dr, lower(coalesce(json_extract_string(sj, '$.features'), '')) AS fs
        FROM (SELECT *, CASE WHEN json_valid(j) THEN j END AS sj FROM (
            SELECT *, replace(replace(specs, '=>', ':'), 'nil', 'null') AS j FROM raw_lots) AS a) AS b) AS c""")
def spec_flags(spark, d):
    return features.spec_flags(i.raw(spark, d, *i.ID, "specs"))


@query("hp_segments", "hp_segment:s, n_rows:i, mean_price:f3", f"""
    SELECT CASE WHEN hp >= 0 AND hp < 60 THEN 'tractors_compact' WHEN hp >= 60 AND hp < 150 THEN 'tractors_utility'
        WHEN hp >= 150 AND hp < 600 THEN 'tractors_rowcrop' END AS hp_segment, count(*) AS n_rows, avg(price) AS mean_price
    FROM hp0 WHERE {_any('raw_category', ['tractor'])} GROUP BY 1""")
def hp_segments(spark, d):
    lots = i.lots(spark, d, "specs", "raw_category").filter(
        filters.contains_any(F.col("raw_category"), RULE["tractors"].terms))
    parsed = lots.withColumn("horsepower", features.parsed_horsepower(F.col("specs")))
    return features.add_hp_segment(parsed).groupBy("hp_segment").agg(
        F.count("*").alias("n_rows"), F.avg("price").alias("mean_price"))


@query("recency_weight", KEY_SPEC + ", weight:f6",
       f"SELECT *, exp(-0.1 * date_diff('day', cast(sold_date AS date), date '{AS_OF}') / 365.25) AS weight FROM lots")
def recency_weight(spark, d):
    age = F.datediff(F.lit(AS_OF).cast("date"), F.col("sold_date").cast("date")) / 365.25
    return i.lots(spark, d, *i.ID).withColumn("weight", features.recency_weight(age))


@query("model_volume", KEY_SPEC + ", model_volume:i", """
    SELECT lots.*, coalesce(n, 0) AS model_volume FROM lots LEFT JOIN (SELECT make_key AS mk, raw_model AS rm, count(*) AS n
        FROM lots GROUP BY ALL) AS v ON v.mk = make_key AND v.rm = raw_model""")
def model_volume(spark, d):
    return features.model_volume_by_make(i.lots(spark, d, *i.ID, "raw_model"))


@query("category_names", "category_key:s, category_name:s, n_rows:i", f"""
    SELECT category_key, CASE category_key WHEN 'tractors' THEN 'Tractors' WHEN 'trucks_and_trailers' THEN 'Trucks and Trailers'
        WHEN 'harvesting' THEN 'Harvesting' WHEN 'loaders_and_lifts' THEN 'Loaders and Lifts'
        WHEN 'construction' THEN 'Construction' WHEN 'applicators' THEN 'Applicators' ELSE 'Other Equipment' END AS category_name,
        count(*) AS n_rows FROM (SELECT {CATEGORY_KEY} AS category_key FROM raw_lots) AS t GROUP BY ALL""")
def category_names(spark, d):
    key = category_key(F.col("raw_category"))
    return (i.raw(spark, d, "raw_category").groupBy(key.alias("category_key")).agg(F.count("*").alias("n_rows"))
             .withColumn("category_name", category_name(F.col("category_key"))))
