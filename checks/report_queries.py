"""Registered queries over profiles, reports, rankings and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotvalue.operators import profiling, ranking, states
from lotvalue.session import materialize
from lotvalue.sources import roles

from . import inputs as i
from .registry import query
from .sql import (
    AS_OF, BY_CATEGORY, KEYS, KEY_SPEC, MONTH, _any, histogram_rows, profile_rows, summary_rows, top_counts,
)


@query("monthly_sales", "month:d, n_sales:i, median_price:f6",
       f"SELECT {MONTH} AS month, count(price) AS n_sales, median(price) AS median_price FROM clean "
       f"WHERE {MONTH} >= '2000-01-01' GROUP BY 1")
def monthly_sales(spark, d):
    return profiling.monthly_sales(i.clean(spark, d, "sold_date", "price"))


@query("yearly_sales", "sale_year:i, n_sales:i, median_price:f0, mean_price:f0",
       "SELECT year(sold_date) AS sale_year, count(price) AS n_sales, round_even(median(price), 0) AS median_price, "
       "round_even(avg(price), 0) AS mean_price FROM clean GROUP BY 1 ORDER BY 1 DESC LIMIT 20")
def yearly_sales(spark, d):
    return profiling.yearly_sales(i.clean(spark, d, "sold_date", "price"))


@query("regional_stats", "region:s, n_sales:i, mean_price:f0, median_price:f0, std_price:f0",
       "SELECT region, count(price) AS n_sales, round_even(avg(price), 0) AS mean_price, "
       "round_even(median(price), 0) AS median_price, round_even(stddev_samp(price), 0) AS std_price FROM clean "
       "WHERE price > 0 AND region IS NOT NULL GROUP BY 1")
def regional_stats(spark, d):
    return profiling.regional_stats(i.clean(spark, d, "region", "price"))


@query("make_stats", "make_key:s, n_sales:i, mean_price:f0, median_price:f0, median_hours:f0",
       "SELECT make_key, count(price) AS n_sales, round_even(avg(price), 0) AS mean_price, "
       "round_even(median(price), 0) AS median_price, round_even(median(hours), 0) AS median_hours FROM clean "
       "WHERE price > 0 AND make_key IS NOT NULL GROUP BY 1 ORDER BY n_sales DESC, make_key LIMIT 20")
def make_stats(spark, d):
    return profiling.make_stats(i.clean(spark, d, "make_key", "price", "hours"))


PROFILED = {"price": "double", "sold_date": "timestamp_ntz", "year": "double", "hours": "double",
            "make_key": "string", "make_model_key": "string", "raw_category": "string", "raw_condition": "string",
            "region": "string", "state": "string"}


@query("column_profile", "column_name:s, dtype:s, non_null:i, null_count:i, coverage_pct:f1, n_distinct:i",
       profile_rows("clean", PROFILED))
def column_profile(spark, d):
    return profiling.column_profile(i.clean(spark, d, *PROFILED))


@query("numeric_summary", "measure:s, n_values:i, mean:f3, std:f3, minimum:f3, q25:f3, q50:f3, q75:f3, maximum:f3",
       summary_rows("clean", ["price", "year", "hours"]))
def numeric_summary(spark, d):
    return profiling.numeric_summary(i.clean(spark, d, "price", "year", "hours"), ["price", "year", "hours"])


BAROMETER = ["barometer", "current_conditions", "future_expectations", "capital_investment_index"]
SERIES_DATES = {"barometer": "date", "diesel": "month_date", "futures": "date"}


@query("macro_summary", "measure:s, n_values:i, mean:f5, std:f3, minimum:f3, q25:f3, q50:f3, q75:f3, maximum:f3",
       summary_rows("barometer", BAROMETER) + " UNION ALL " + summary_rows("diesel", ["price_usd_per_gallon"]))
def macro_summary(spark, d):
    return profiling.numeric_summary(roles.barometer(spark, d), BAROMETER).unionByName(
        profiling.numeric_summary(roles.diesel(spark, d), ["price_usd_per_gallon"]))


@query("macro_date_ranges", "series:s, n_values:i, first_date:d, last_date:d", " UNION ALL ".join(
    f"SELECT '{t}' AS series, count({c}) AS n_values, min({c}) AS first_date, max({c}) AS last_date FROM {t}"
    for t, c in SERIES_DATES.items()))
def macro_date_ranges(spark, d):
    return profiling.date_ranges({t: (getattr(roles, t)(spark, d), c) for t, c in SERIES_DATES.items()})


@query("field_summary", "n_price:i, min_price:f3, max_price:f3, mean_price:f3, median_price:f6, n_hours:i, "
       "min_hours:f2, max_hours:f2, mean_hours:f2, median_hours:f2, first_date:d, last_date:d, min_year:f0, max_year:f0",
       "SELECT count(price) AS n_price, min(price) FILTER (price > 0) AS min_price, max(price) FILTER (price > 0) AS max_price, "
       "avg(price) FILTER (price > 0) AS mean_price, median(price) FILTER (price > 0) AS median_price, "
       "count(hours) AS n_hours, min(hours) FILTER (hours > 0) AS min_hours, max(hours) FILTER (hours > 0) AS max_hours, "
       "avg(hours) FILTER (hours > 0) AS mean_hours, median(hours) FILTER (hours > 0) AS median_hours, "
       "min(sold_date) AS first_date, max(sold_date) AS last_date, min(year) AS min_year, max(year) AS max_year FROM clean")
def field_summary(spark, d):
    return profiling.field_summary(i.clean(spark, d, "price", "hours", "sold_date", "year"))


@query("exploration_summary", "total_records:i, first_date:d, last_date:d, price_coverage:f6, hours_coverage:f6, "
       "region_coverage:f6, unique_makes:i, unique_regions:i, usable_records:i, usable_recent:i", f"""
    SELECT count(*) AS total_records, min(sold_date) AS first_date, max(sold_date) AS last_date,
        count(price) / count(*)::double AS price_coverage, count(hours) / count(*)::double AS hours_coverage,
        count(region) / count(*)::double AS region_coverage, count(DISTINCT make_key) AS unique_makes,
        count(DISTINCT region) AS unique_regions,
        count(*) FILTER (price > 0 AND sold_date IS NOT NULL AND make_key IS NOT NULL) AS usable_records,
        count(*) FILTER (price > 0 AND make_key IS NOT NULL AND sold_date >= cast('{AS_OF}' AS date) - INTERVAL 7 YEAR)
            AS usable_recent FROM clean""")
def exploration_summary(spark, d):
    return profiling.exploration_summary(i.clean(spark, d, "price", "sold_date", "hours", "make_key", "region"), AS_OF)


@query("distinct_counts", "field:s, n_distinct:i", " UNION ALL ".join(
    f"SELECT '{c}' AS field, count(DISTINCT {c}) AS n_distinct FROM clean" for c in ("make_key", "region", "raw_category")))
def distinct_counts(spark, d):
    return profiling.distinct_counts(i.clean(spark, d, "make_key", "region", "raw_category"),
                                     ["make_key", "region", "raw_category"])


TOP = {"make_key": 15, "raw_condition": 10, "raw_category": 20, "region": None}


@query("value_counts_topn", "field:s, value:s, n:i",
       "SELECT * FROM (" + " UNION ALL ".join(f"({top_counts('clean', c, n)})" for c, n in TOP.items()) + ") AS u")
def value_counts_topn(spark, d):
    tops = [profiling.value_counts(i.clean(spark, d, c), c, n)
            .select(F.lit(c).alias("field"), F.col(c).alias("value"), "n") for c, n in TOP.items()]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


@query("phase_counts", "phase:f1, n:i", "SELECT phase, count(*) AS n FROM el_nino GROUP BY 1")
def phase_counts(spark, d):
    return profiling.value_counts(roles.el_nino(spark, d), "phase")


@query("month_count_summary", "months:i, mean_sales:f4, min_sales:i, max_sales:i",
       f"SELECT count(*) AS months, avg(n) AS mean_sales, min(n) AS min_sales, max(n) AS max_sales FROM ("
       f"SELECT {MONTH} AS m, count(*) AS n FROM lots GROUP BY 1) AS t")
def month_count_summary(spark, d):
    return profiling.month_count_summary(i.lots(spark, d))


@query("seasonality", "sale_month:i, median_price:f6",
       "SELECT month(sold_date) AS sale_month, median(price) AS median_price FROM lots GROUP BY 1")
def seasonality(spark, d):
    return profiling.seasonality(i.lots(spark, d))


HISTOGRAM_SPEC = "bin:i, lower:f4, upper:f4, n:i"
PLOTTED = "price > 0 AND price < 2000000"


@query("price_histogram", HISTOGRAM_SPEC, histogram_rows("clean", "price", PLOTTED, 100))
def price_histogram(spark, d):
    return profiling.histogram(i.clean(spark, d, "price").filter(PLOTTED), F.col("price"), 100)


@query("log_price_histogram", HISTOGRAM_SPEC, histogram_rows("clean", "log10(price)", PLOTTED, 100))
def log_price_histogram(spark, d):
    return profiling.histogram(i.clean(spark, d, "price").filter(PLOTTED), F.log10("price"), 100)


@query("hours_histogram", HISTOGRAM_SPEC, histogram_rows("clean", "hours", "hours IS NOT NULL", 100))
def hours_histogram(spark, d):
    return profiling.histogram(i.clean(spark, d, "hours"), F.col("hours"), 100)


@query("age_histogram", HISTOGRAM_SPEC, histogram_rows("equipped", "equipment_age", "equipment_age IS NOT NULL", 50))
def age_histogram(spark, d):
    from lotvalue.operators.features import add_age_and_use
    return profiling.histogram(add_age_and_use(i.lots(spark, d, "year", "hours")), F.col("equipment_age"), 50)


@query("hours_per_year_histogram", HISTOGRAM_SPEC, histogram_rows(
    "equipped", "hours_per_year", "hours_per_year IS NOT NULL", 50))
def hours_per_year_histogram(spark, d):
    from lotvalue.operators.features import add_age_and_use
    return profiling.histogram(add_age_and_use(i.lots(spark, d, "year", "hours")), F.col("hours_per_year"), 50)


@query("make_volume_histogram", HISTOGRAM_SPEC, histogram_rows(
    "(SELECT ln(1 + coalesce(count(make_model_key) OVER (PARTITION BY make_model_key), 1)) AS volume, make_model_key FROM lots)",
    "volume", "make_model_key IS NOT NULL", 50))
def make_volume_histogram(spark, d):
    from lotvalue.operators.features import FeaturePipeline
    lots = i.lots(spark, d, "make_model_key").filter("make_model_key IS NOT NULL").select("make_model_key")
    fitted = FeaturePipeline().fit(lots)
    return profiling.histogram(fitted.add_levels(lots), F.col("log_make_volume"), 50)


@query("distinct_by_range", "first_year:i, last_year:i, feature:s, n_exact:i, within_error:i", """
    SELECT r.first_year, r.last_year, v.feature, count(DISTINCT v.level) AS n_exact, 1 AS within_error
    FROM (SELECT DISTINCT year(sold_date) AS first_year, (SELECT max(year(sold_date)) FROM lots) AS last_year FROM lots) AS r
    JOIN (SELECT year(sold_date) AS y, 'make_model_key' AS feature, make_model_key AS level FROM lots
          UNION ALL SELECT year(sold_date), 'region', region FROM lots) AS v ON v.y BETWEEN r.first_year AND r.last_year
    GROUP BY ALL""")
def distinct_by_range(spark, d):
    """Distinct values from each year to the last: exact, and whether the merged sketches are within three standard errors."""
    names = ["make_model_key", "region"]
    lots = i.lots(spark, d, "sold_date", *names).withColumn("year", F.year("sold_date")).select("year", *names)
    stored = materialize(states.distinct_states(lots, "year", names), "distinct-states")
    years = stored.select("year").distinct()
    ranges = years.select(F.col("year").alias("first_year")).crossJoin(F.broadcast(years.agg(F.max("year").alias("last_year"))))   # one row
    inside = F.col("year").between(F.col("first_year"), F.col("last_year"))
    estimated = states.merge_distinct(stored.join(F.broadcast(ranges), inside), ["first_year", "last_year"])        # one row per year
    pairs = lots.unpivot(["year"], names, "feature", "level").filter("level IS NOT NULL").distinct()
    exact = pairs.join(F.broadcast(ranges), inside).groupBy("first_year", "last_year", "feature").agg(
        F.count_distinct("level").alias("n_exact"))
    error = 3 * 1.04 / 2 ** (states.LG_BUCKETS / 2)
    return exact.join(estimated, ["first_year", "last_year", "feature"]).withColumn(
        "within_error", (F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.ceil(F.col("n_exact") * error)).cast("int"))


@query("merged_fit_stats", "barometer_mean:f4, barometer_std:f4, diesel_mean:f4", "SELECT * FROM stats")
def merged_fit_stats(spark, d):
    """Merged from the stored states of every sale year."""
    lots = i.training(spark, d).withColumn("year", F.year("sold_date"))
    return states.merged_fit(materialize(states.moment_states(lots, "year", ["barometer", "diesel_price"]), "moment-states"))


@query("merged_frequencies", "feature:s, level:s, n:i", "SELECT * FROM levels")
def merged_frequencies(spark, d):
    wanted = ["make_model_key", "region", "raw_category", "raw_model"]
    lots = i.lots(spark, d, *wanted).withColumn("year", F.year("sold_date"))
    return states.merge_levels(materialize(states.level_states(lots, "year", wanted), "level-states"))


@query("region_boxplot", "region:s, n:i, q1:f6, median:f6, q3:f6, whisker_low:f3, whisker_high:f3, outliers:i", """
    SELECT region, q1, median, q3, count(*) AS n, min(price) FILTER (price BETWEEN lo AND hi) AS whisker_low,
        max(price) FILTER (price BETWEEN lo AND hi) AS whisker_high, count(*) FILTER (price < lo OR price > hi) AS outliers
    FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
        SELECT region, price, quantile_cont(price, 0.25) OVER w AS q1, quantile_cont(price, 0.5) OVER w AS median,
            quantile_cont(price, 0.75) OVER w AS q3 FROM clean WHERE price > 0 AND price < 500000 AND region IS NOT NULL
        WINDOW w AS (PARTITION BY region)) AS a) AS b GROUP BY ALL""")
def region_boxplot(spark, d):
    return profiling.box_plot(i.clean(spark, d, "region", "price").filter("price > 0 AND price < 500000"),
                              "region", "price")


@query("dataset_summary", "n_rows:i, min_price:f3, max_price:f3, median_price:f6, first_date:d, last_date:d, "
       "min_log_price:f6, max_log_price:f6",
       "SELECT count(*) AS n_rows, min(price) AS min_price, max(price) AS max_price, median(price) AS median_price, "
       "min(ln(price)) AS min_log_price, max(ln(price)) AS max_log_price, min(sold_date) AS first_date, max(sold_date) AS last_date FROM lots")
def dataset_summary(spark, d):
    return profiling.dataset_summary(i.lots(spark, d))


@query("makes_overview", "n_makes:i, n_in_business:i",
       "SELECT count(*) AS n_makes, sum(still_in_business) AS n_in_business FROM makes")
def makes_overview(spark, d):
    return profiling.makes_overview(roles.makes(spark, d))


@query("makes_sample", "make_key:s, name:s, still_in_business:i, headquarters_country_iso_2:s, production_year_start:i, production_year_end:i",
       "SELECT * FROM makes ORDER BY make_key, name LIMIT 10")
def makes_sample(spark, d):
    return profiling.makes_sample(roles.makes(spark, d))


def _lists() -> str:
    parts = []
    for kind, column in (("make", "make_key"), ("region", "region")):
        for key, terms in {**BY_CATEGORY, "other": None}.items():
            where = _any("raw_category", terms) if terms else "true"
            parts.append(f"SELECT DISTINCT '{key}' AS category_key, '{kind}' AS kind, {column} AS value FROM lots "
                         f"WHERE {column} IS NOT NULL AND {where}")
    return " UNION ALL ".join(parts)


@query("reference_lists", "category_key:s, kind:s, value:s", _lists())
def reference_lists(spark, d):
    return profiling.reference_lists(i.lots(spark, d, "region", "raw_category"))


@query("top_models_per_make", "category_key:s, make_key:s, model:s, model_no:i",
       "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_key, make_key ORDER BY model) AS model_no FROM ("
       + " UNION ALL ".join(
           f"SELECT DISTINCT '{k}' AS category_key, make_key, raw_model AS model FROM lots WHERE raw_model <> '' "
           f"AND {_any('raw_category', t)}" for k, t in BY_CATEGORY.items()) + ") AS t) AS u WHERE model_no <= 100")
def top_models_per_make(spark, d):
    return profiling.top_models(i.lots(spark, d, "raw_model", "raw_category"))


@query("sorted_makes", "make_key:s", "SELECT DISTINCT make_key FROM clean WHERE make_key IS NOT NULL ORDER BY 1")
def sorted_makes(spark, d):
    return profiling.sorted_distinct(i.clean(spark, d, "make_key"), "make_key")


@query("sales_by_date", KEY_SPEC + ", sold_date:d", f"SELECT {KEYS}, sold_date FROM raw_lots ORDER BY sold_date")
def sales_by_date(spark, d):
    return profiling.total_sort(i.raw(spark, d, *i.ID, "sold_date"), "sold_date", *i.ID)


@query("sample_rows", KEY_SPEC, f"SELECT {KEYS} FROM raw_lots ORDER BY md5(concat_ws('|', 42, {KEYS})), {KEYS} LIMIT 5000")
def sample_rows(spark, d):
    return profiling.sample_rows(i.raw(spark, d, *i.ID), 5000, i.ID)


@query("date_rank", KEY_SPEC + ", sold_date:d, position:i", "SELECT * FROM ranked")
def date_rank(spark, d):
    return ranking.positional_rank(i.lots(spark, d, *i.TIES), "sold_date", i.TIES, bucket=i.bucket())


@query("time_split", KEY_SPEC + ", sold_date:d, split:s", "SELECT * FROM split_lots")
def time_split(spark, d):
    return i.split_lots(spark, d)


@query("split_summary", "split:s, n_rows:i, min_price:f3, max_price:f3, median_price:f6, first_date:d, last_date:d",
       "SELECT split, count(*) AS n_rows, min(price) AS min_price, max(price) AS max_price, median(price) AS median_price, "
       "min(sold_date) AS first_date, max(sold_date) AS last_date FROM split_lots GROUP BY 1")
def split_summary(spark, d):
    return profiling.dataset_summary(i.split_lots(spark, d), ["split"])


def _trend(spark, d):
    return ranking.rolling_trend(i.clean(spark, d, *i.TIES, "sold_date", "price", "make_model_key"),
                                 "make_model_key", "sold_date", i.TIES, "price", bucket=i.bucket())


@query("rolling_price_trend", KEY_SPEC + ", make_model_key:s, rolling_mean:f6", "SELECT * FROM trend")
def rolling_price_trend(spark, d):
    return _trend(spark, d)


@query("price_momentum", KEY_SPEC + ", make_model_key:s, momentum:f6", "SELECT * FROM trend")
def price_momentum(spark, d):
    return _trend(spark, d)
