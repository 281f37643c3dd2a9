"""Registered queries over evaluation, routing, valuation and model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotvalue.functions.rules import CATEGORY_RULES, MAKE_CATEGORY_RULES, OTHER, category_key, make_category_key
from lotvalue.operators import cleaning, evaluate, forest, profiling, routing, training, valuation
from lotvalue.operators.training import TrainingConfig, train_model
from lotvalue.plans import fanout
from lotvalue.plans.batch_valuation import value_requests
from lotvalue.session import materialize, new_path
from lotvalue.sources import roles
from lotvalue.streaming import monitoring

from . import inputs as i
from .registry import query
from .sql import (
    AS_OF, AS_OF_YEAR, CATEGORY_KEY, KEYS, KEY_SPEC, MAKE_CATEGORY_KEY, histogram_rows,
)

REGISTRY_SPEC = ("tier:s, model_key:s, method:s, n_train:i, n_val:i, n_test:i, val_rmse:f3, val_mape:f4, val_r2:f5, "
                 "test_rmse:f3, test_mape:f4, test_r2:f5")


@query("metrics", "split:s, n:i, rmse:f3, mape:f4, r2:f5", """
    SELECT split, count(*) AS n, sqrt(avg((price - prediction) * (price - prediction))) AS rmse,
        avg(abs(price - prediction) / abs(price)) * 100 AS mape,
        1 - sum((price - prediction) * (price - prediction)) / nullif(var_pop(price) * count(price), 0) AS r2
    FROM scored GROUP BY 1""")
def metrics(spark, d):
    return evaluate.metrics(i.scored(spark, d), ["split"])


@query("model_registry", REGISTRY_SPEC, "SELECT * FROM registry")
def model_registry(spark, d):
    return i.registry(spark, d)


EXPECTED = ", ".join(f"('{t}', '{k}')" for t, k in [
    *[("category", r.key) for r in CATEGORY_RULES], ("generic", OTHER.key),
    *[("make_category", r.key) for r in MAKE_CATEGORY_RULES]])


@query("available_models", "tier:s, model_key:s, method:s, available:i, test_mape:f3", f"""
    SELECT e.tier, e.model_key, m.method, CASE WHEN r.n_train IS NULL THEN 0 ELSE 1 END AS available, r.test_mape
    FROM (VALUES {EXPECTED}) AS e(tier, model_key) CROSS JOIN (VALUES ('log'), ('regular')) AS m(method)
    LEFT JOIN registry AS r ON r.tier = e.tier AND r.model_key = e.model_key AND r.method = m.method""")
def available_models(spark, d):
    return routing.available_models(i.registry(spark, d))


@query("goal_check", "tier:s, model_key:s, method:s, met_mape:i, met_r2:i, met_rmse:i, goals_met:i", """
    SELECT *, met_mape + met_r2 + met_rmse AS goals_met FROM (SELECT tier, model_key, method,
        CASE WHEN test_mape < 10 THEN 1 ELSE 0 END AS met_mape, CASE WHEN test_r2 > 0.85 THEN 1 ELSE 0 END AS met_r2,
        CASE WHEN test_rmse < 15000 THEN 1 ELSE 0 END AS met_rmse FROM registry) AS t""")
def goal_check(spark, d):
    return evaluate.goal_check(i.registry(spark, d))


@query("run_summary", "method:s, n_models:i, mean_mape:f4, mean_r2:f5",
       "SELECT method, count(*) AS n_models, avg(test_mape) AS mean_mape, avg(test_r2) AS mean_r2 FROM registry GROUP BY 1")
def run_summary(spark, d):
    return routing.run_summary(i.registry(spark, d))


@query("best_models", "tier:s, model_key:s, method:s, test_mape:f4",
       "SELECT * FROM registry ORDER BY test_mape, tier, model_key, method LIMIT 5")
def best_models(spark, d):
    return routing.best_models(i.registry(spark, d))


ERRORS = """(SELECT *, abs(price - prediction) AS abs_error, abs((price - prediction) / price * 100) AS pct_error
             FROM scored WHERE split = 'test')"""
BANDS = ", ".join(f"n_within_{b}:i, pct_within_{b}:f4" for b in evaluate.ERROR_BANDS)


@query("error_analysis", "n:i, mean_actual:f3, mean_predicted:f3, mean_abs_error:f3, median_abs_error:f3, "
       "mean_pct_error:f4, median_pct_error:f4, " + BANDS,
       "SELECT count(*) AS n, avg(price) AS mean_actual, avg(prediction) AS mean_predicted, avg(abs_error) AS mean_abs_error, "
       "median(abs_error) AS median_abs_error, avg(pct_error) AS mean_pct_error, median(pct_error) AS median_pct_error, "
       + ", ".join(f"count(*) FILTER (pct_error <= {b}) AS n_within_{b}, "
                   f"count(*) FILTER (pct_error <= {b}) * 100.0::double / count(*) AS pct_within_{b}"
                   for b in evaluate.ERROR_BANDS)
       + f" FROM {ERRORS} AS e")
def error_analysis(spark, d):
    return evaluate.error_analysis(i.scored(spark, d).filter("split = 'test'"))


@query("error_ecdf", "pct_error:f1, n_upto:i, cumulative_pct:f4", f"""
    SELECT bin * 0.5::double AS pct_error, sum(n) OVER (ORDER BY bin) AS n_upto,
        sum(n) OVER (ORDER BY bin) * 100.0::double / sum(n) OVER () AS cumulative_pct
    FROM (SELECT ceil(e.pct_error / 0.5) AS bin, count(*) AS n FROM {ERRORS} AS e WHERE e.pct_error IS NOT NULL GROUP BY 1) AS b""")
def error_ecdf(spark, d):
    return evaluate.error_ecdf(i.scored(spark, d).filter("split = 'test'"))


@query("error_histogram", "bin:i, lower:f4, upper:f4, n:i",
       histogram_rows("scored", "abs((price - prediction) / price * 100)", "split = 'test'", 100))
def error_histogram(spark, d):
    errors = evaluate.with_errors(i.scored(spark, d).filter("split = 'test'"))
    return profiling.histogram(errors, F.col("pct_error"), 100)


@query("residual_sample", KEY_SPEC + ", price:f3, prediction:f8, error:f8",
       f"SELECT *, price - prediction AS error FROM scored WHERE split = 'test' "
       f"ORDER BY md5(concat_ws('|', 42, {KEYS})), {KEYS} LIMIT 5000")
def residual_sample(spark, d):
    errors = evaluate.with_errors(i.scored(spark, d).filter("split = 'test'"))
    return profiling.sample_rows(errors, 5000, i.ID)


# -- routing ---------------------------------------------------------------------------------------------------

@query("category_route", "raw_category:s, category_key:s, n_rows:i",
       f"SELECT raw_category, {CATEGORY_KEY} AS category_key, count(*) AS n_rows FROM raw_lots GROUP BY ALL")
def category_route(spark, d):
    return (i.raw(spark, d, "raw_category").groupBy("raw_category").agg(F.count("*").alias("n_rows"))
             .withColumn("category_key", category_key(F.col("raw_category"))))


@query("make_category_route", "make_key:s, raw_category:s, make_category_key:s, n_rows:i",
       f"SELECT make_key, raw_category, {MAKE_CATEGORY_KEY} AS make_category_key, count(*) AS n_rows FROM raw_lots GROUP BY ALL")
def make_category_route(spark, d):
    return (i.raw(spark, d, "make_key", "raw_category").groupBy("make_key", "raw_category")
             .agg(F.count("*").alias("n_rows"))
             .withColumn("make_category_key", make_category_key(F.col("make_key"), F.col("raw_category"))))


@query("model_route", KEY_SPEC + ", tier:s, model_key:s", "SELECT * FROM routed")
def model_route(spark, d):
    return routing.route(i.requests(spark, d), i.registry(spark, d))


@query("route_coverage", "tier:s, n_requests:i, pct:f4",
       "SELECT coalesce(tier, 'none') AS tier, count(*) AS n_requests, count(*) * 100.0::double / sum(count(*)) OVER () AS pct "
       "FROM routed GROUP BY 1")
def route_coverage(spark, d):
    return routing.route_coverage(routing.route(i.requests(spark, d), i.registry(spark, d)))


@query("method_improvement", "tier:s, model_key:s, regular_mape:f4, log_mape:f4, gain_pct:f4", """
    SELECT r.tier, r.model_key, r.test_mape AS regular_mape, l.test_mape AS log_mape,
        (r.test_mape - l.test_mape) / r.test_mape * 100 AS gain_pct
    FROM registry AS r JOIN registry AS l ON r.method = 'regular' AND l.method = 'log' AND r.tier = l.tier
        AND r.model_key = l.model_key""")
def method_improvement(spark, d):
    return routing.method_improvement(i.registry(spark, d))


@query("specific_improvement", "make_category_key:s, category_key:s, specific_mape:f4, general_mape:f4, change_pct:f4", f"""
    SELECT mk AS make_category_key, ck AS category_key, s.test_mape AS specific_mape, g.test_mape AS general_mape,
        (s.test_mape / g.test_mape - 1) * 100 AS change_pct
    FROM (SELECT DISTINCT {MAKE_CATEGORY_KEY} AS mk, {CATEGORY_KEY} AS ck FROM lots) AS k
    JOIN registry AS s ON s.method = 'log' AND s.tier = 'make_category' AND s.model_key = mk
    JOIN registry AS g ON g.method = 'log' AND g.tier = 'category' AND g.model_key = ck""")
def specific_improvement(spark, d):
    pairs = i.lots(spark, d, "raw_category").select(
        make_category_key(F.col("make_key"), F.col("raw_category")).alias("make_category_key"),
        category_key(F.col("raw_category")).alias("category_key")).distinct()
    return routing.specific_improvement(i.registry(spark, d), pairs)


# -- requests and valuation ------------------------------------------------------------------------------------

@query("request_defaults", KEY_SPEC + ", make_model_key:s, raw_model:s, raw_condition:s, barometer:f2, "
       "current_conditions:f1, future_expectations:f1, capital_investment_index:f1, diesel_price:f2, el_nino_phase:f1",
       "SELECT * FROM requests")
def request_defaults(spark, d):
    return i.requests(spark, d)


@query("request_validation", KEY_SPEC + ", ok_year:i, ok_condition:i, ok_hours:i, ok_barometer:i, ok_diesel_price:i, "
       "is_valid:i", f"""
    SELECT *, least(ok_year, ok_condition, ok_hours, ok_barometer, ok_diesel_price) AS is_valid FROM (SELECT *,
        CASE WHEN year BETWEEN 1980 AND {AS_OF_YEAR + 1} THEN 1 ELSE 0 END AS ok_year,
        CASE WHEN raw_condition IN ('Excellent', 'Good', 'Fair', 'Poor') THEN 1 ELSE 0 END AS ok_condition,
        CASE WHEN hours BETWEEN 0 AND 50000 THEN 1 ELSE 0 END AS ok_hours,
        CASE WHEN barometer BETWEEN 50 AND 200 THEN 1 ELSE 0 END AS ok_barometer,
        CASE WHEN diesel_price BETWEEN 1 AND 10 THEN 1 ELSE 0 END AS ok_diesel_price FROM requests) AS t""")
def request_validation(spark, d):
    return cleaning.validate_requests(i.requests(spark, d), AS_OF_YEAR)


@query("confidence_band", KEY_SPEC + ", tier:s, model_key:s, prediction:f2, test_mape:f4, lower:f6, upper:f6", """
    SELECT *, greatest(prediction * (1 - test_mape / 100), 0) AS lower, prediction * (1 + test_mape / 100) AS upper
    FROM priced""")
def confidence_band(spark, d):
    return valuation.confidence_band(i.priced(spark, d)[0])


@query("method_comparison", KEY_SPEC + ", prediction:f2, other_prediction:f2, difference:f3, difference_pct:f4, "
       "better_method:s", """
    SELECT *, abs(prediction - other_prediction) AS difference,
        CASE WHEN prediction > 0 THEN abs(prediction - other_prediction) / prediction * 100 ELSE 0 END AS difference_pct,
        CASE WHEN test_mape < other_test_mape THEN method ELSE other_method END AS better_method FROM both_methods""")
def method_comparison(spark, d):
    current, known = i.priced(spark, d)
    other = known.filter("method = 'regular'").select("tier", "model_key", F.col("test_mape").alias("other_test_mape"))
    price = F.when(F.col("lot_line") == 7, 0).otherwise(9500 + 90 * (F.col("lot_part") % 97))
    both = (current.join(F.broadcast(other), ["tier", "model_key"])      # one row per rule
                   .withColumns({"method": F.lit("log"), "other_method": F.lit("regular"), "other_prediction": price}))
    return valuation.compare_methods(both)


@query("utilization_insight", KEY_SPEC + ", insight_hours_per_year:f3, usage_insight:s", f"""
    SELECT *, CASE WHEN hpy IS NULL THEN 'Enter valid hours and year for analysis'
        WHEN hpy < 300 THEN 'Light usage - Premium value' WHEN hpy < 600 THEN 'Normal usage - Good value'
        WHEN hpy < 1000 THEN 'Heavy usage - Fair value' ELSE 'Extreme usage - Reduced value' END AS usage_insight,
        hpy AS insight_hours_per_year
    FROM (SELECT *, CASE WHEN hours > 0 AND {AS_OF_YEAR} - year > 0 THEN hours / ({AS_OF_YEAR} - year) END AS hpy
          FROM requests) AS t""")
def utilization_insight(spark, d):
    return valuation.utilization_insight(i.requests(spark, d), AS_OF_YEAR)


@query("market_sentiment", "market_sentiment:s, barometer:f2, n_rows:i", """
    SELECT CASE WHEN barometer > 120 THEN 'Strong confidence - Prices trending up' WHEN barometer > 90 THEN 'Stable market'
        ELSE 'Weak sentiment - Softer prices' END AS market_sentiment, barometer, count(*) AS n_rows FROM requests GROUP BY ALL""")
def market_sentiment(spark, d):
    return valuation.market_sentiment(i.requests(spark, d)).groupBy("market_sentiment", "barometer").agg(
        F.count("*").alias("n_rows"))


@query("equipment_summary", KEY_SPEC + ", display_make:s, age_years:f1, display_hours_per_year:f3", f"""
    SELECT *, CASE make_key WHEN 'john-deere' THEN 'John Deere' WHEN 'ford' THEN 'Ford' WHEN 'case-ih' THEN 'Case Ih'
            WHEN 'chevrolet' THEN 'Chevrolet' WHEN 'new-holland' THEN 'New Holland' ELSE replace(make_key, 'b', 'B') END AS display_make,
        {AS_OF_YEAR} - year AS age_years,
        CASE WHEN {AS_OF_YEAR} - year > 0 THEN hours / ({AS_OF_YEAR} - year) END AS display_hours_per_year FROM requests""")
def equipment_summary(spark, d):
    return valuation.equipment_summary(i.requests(spark, d), AS_OF_YEAR)


@query("ensemble", KEY_SPEC + ", prediction:f9", """
    SELECT * EXCLUDE (prediction), 0.5::double * prediction
        + 0.3::double * (price * (0.7::double + 0.05::double * lot_line))
        + 0.2::double * (price * (0.95::double + 0.01::double * lot_line)) AS prediction
    FROM scored""")
def ensemble(spark, d):
    rows = i.scored(spark, d)
    methods = F.array(*[F.struct(F.lit(m).alias("method"), p.alias("prediction")) for m, p in (
        ("log", F.col("prediction")), ("regular", F.col("price") * (0.7 + 0.05 * F.col("lot_line"))),
        ("third", F.col("price") * (0.95 + 0.01 * F.col("lot_line"))))])
    return routing.ensemble(rows.select(*i.TIES, F.inline(methods)), i.TIES)


MONITOR_SQL = """
    SELECT make_key, count(*) AS n, sqrt(avg((price - prediction) * (price - prediction))) AS rmse,
        avg(abs(price - prediction) / abs(price)) * 100 AS mape,
        1 - sum((price - prediction) * (price - prediction)) / nullif(var_pop(price) * count(price), 0) AS r2
    FROM scored WHERE split = 'test' GROUP BY 1"""


@query("prediction_monitor", "make_key:s, n:i, rmse:f3, mape:f4, r2:f5", MONITOR_SQL)
def prediction_monitor(spark, d):
    logged = i.scored(spark, d).filter("split = 'test'").select(*i.TIES, "make_key", "prediction")
    return valuation.monitor(logged, i.lots(spark, d, *i.TIES).select(*i.TIES, "price"), i.TIES, ["make_key"])


@query("prediction_monitor_stream", "make_key:s, n:i, rmse:f3, mape:f4, r2:f5", MONITOR_SQL)
def prediction_monitor_stream(spark, d):
    """The same from a prediction log and a feed of sales, read as streams until both are used up."""
    scored = i.scored(spark, d).filter("split = 'test'")
    at = F.col("sold_date").cast("timestamp")
    log, feed = new_path(spark, "prediction-log"), new_path(spark, "sales")
    valuation.log_predictions(scored.select(*i.TIES, "make_key", "prediction", (at - F.expr("INTERVAL 1 DAY")).alias("predicted_at")), log, "one")
    scored.select(*i.TIES, "price", at.alias("sold_at")).write.parquet(feed)
    streams = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (log, feed)]
    out = new_path(spark, "monitor")
    monitoring.monitor_stream(*streams, i.TIES, ["make_key"], out, new_path(spark, "monitor-checkpoint")).awaitTermination()
    return monitoring.monitored(spark, out, ["make_key"])


# -- trained models: checked by row counts and by the tests ----------------------------------------------------

CONFIG = TrainingConfig()
METHODS = ["regular", "log"]
FLOOR = 50                              # lots that a segment of the small test tables needs
MODEL_COLUMNS = ["sold_date", "price", "hours", "year", "make_key", "make_model_key", "raw_model", "raw_category",
                 "raw_condition", "region", "specs"]


def _enriched(spark, d):
    return i.stored_training(spark, d, *i.TIES, *MODEL_COLUMNS)


_trained: dict = {}                     # what this application has trained, for the queries that share it


def _one_model(spark, d, method):
    key = (spark.sparkContext.applicationId, d, "all", method)
    if key not in _trained:
        _trained[key] = train_model(_enriched(spark, d), "all", method, i.TIES, CONFIG, i.bucket())
    return _trained[key]


REGIONS = ["africa", "america", "asia", "europe", "middle east"]


def _leaf(tree, weight, node, value):
    return F.struct(F.lit(tree).alias("tree"), F.lit(weight).alias("weight"), F.lit(node).alias("node"), F.lit(None).cast("string").alias("feature"),
                    F.lit(None).cast("double").alias("threshold"), F.lit(None).cast("array<int>").alias("levels"),
                    F.lit(-1).alias("left"), F.lit(-1).alias("right"), F.lit(value).cast("double").alias("prediction"))


def _split(tree, weight, node, feature, left, right, threshold=None, levels=None):
    return F.struct(F.lit(tree).alias("tree"), F.lit(weight).alias("weight"), F.lit(node).alias("node"), F.lit(feature).alias("feature"),
                    F.lit(threshold).cast("double").alias("threshold"),
                    (F.array(*map(F.lit, levels)) if levels else F.lit(None)).cast("array<int>").alias("levels"),
                    F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(None).cast("double").alias("prediction"))


@query("tree_scoring", KEY_SPEC + ", model_key:s, score:f4", f"""
    SELECT q.*, CASE WHEN q.hours <= h THEN p WHEN q.year <= y THEN p / 2 ELSE p / 4 END
        + 0.5::double * CASE WHEN q.region IN ('africa', 'asia') THEN 100 WHEN q.hours <= h / 2 THEN 40 ELSE 20 END AS score
    FROM (SELECT *, {CATEGORY_KEY} AS model_key FROM requests) AS q LEFT JOIN (
        SELECT {CATEGORY_KEY} AS k, floor(avg(hours)) AS h, floor(avg(year)) AS y, floor(avg(price)) AS p FROM lots GROUP BY 1) AS s
    ON s.k = q.model_key""")
def tree_scoring(spark, d):
    """A table of small trees, one pair per category, with its thresholds and leaves from the lots: scored in one pass."""
    fitted = i.lots(spark, d, "hours", "year", "price", "raw_category").groupBy(category_key(F.col("raw_category")).alias("model_key")).agg(
        F.floor(F.avg("hours")).alias("h"), F.floor(F.avg("year")).alias("y"), F.floor(F.avg("price")).alias("p"))
    h, y, p = F.col("h"), F.col("y"), F.col("p")
    nodes = F.array(_split(0, 1.0, 0, "hours", 1, 2, h), _leaf(0, 1.0, 1, p), _split(0, 1.0, 2, "year", 3, 4, y),
                    _leaf(0, 1.0, 3, p / 2), _leaf(0, 1.0, 4, p / 4), _split(1, 0.5, 0, "region", 1, 2, levels=[0, 2]),
                    _leaf(1, 0.5, 1, F.lit(100)), _split(1, 0.5, 2, "hours", 3, 4, h / 2), _leaf(1, 0.5, 3, F.lit(40)), _leaf(1, 0.5, 4, F.lit(20)))
    table = materialize(fitted.select("model_key", F.inline(nodes)).withColumns({"gain": F.lit(0.0), "rows": F.lit(0)}), "nodes")
    code = F.array_position(F.array(*map(F.lit, REGIONS)), F.col("region"))
    x = F.array(F.col("hours").cast("double"), F.col("year").cast("double"),
                F.when(code > 0, code - 1).otherwise(len(REGIONS)).cast("double"))
    rows = i.requests(spark, d).withColumn("model_key", category_key(F.col("raw_category")))
    return forest.with_scores(rows, x, table, ["hours", "year", "region"], "model_key", name="score")


MODEL_SPEC = ("tier:s, model_key:s, method:s, target_transform:s, n_train:i, n_val:i, n_test:i, n_trees:i, best_iteration:i, "
              "test_rmse:f2, test_mape:f3, test_r2:f4")


@query("train_price_gbt", MODEL_SPEC)
def train_price_gbt(spark, d):
    return fanout.registry(spark, {("generic", "all", "regular"): _one_model(spark, d, "regular")})


@query("train_log_gbt", MODEL_SPEC)
def train_log_gbt(spark, d):
    return fanout.registry(spark, {("generic", "all", "log"): _one_model(spark, d, "log")})


@query("feature_importance", "feature:s, importance:f6, n_splits:i")
def feature_importance(spark, d):
    return _one_model(spark, d, "log").feature_importance()


@query("validation_curve", "model:s, round:i, val_error:f6, is_best:i")
def validation_curve(spark, d):
    return _one_model(spark, d, "log").validation_curve().withColumn("model", F.lit("all_log"))


FOLDS, PRIOR = 5, 20.0


@query("level_means_by_fold", "feature:s, level:s, fold:i, n:i, mean:f6", f"""
    SELECT t.feature, t.level, f.fold, t.n - coalesce(o.n, 0) AS n,
        (t.total - coalesce(o.total, 0) + a.overall * {PRIOR}::double) / (t.n - coalesce(o.n, 0) + {PRIOR}::double) AS mean
    FROM (SELECT feature, level, count(label) AS n, sum(label) AS total FROM rows_by_feature GROUP BY 1, 2) AS t
    CROSS JOIN (SELECT unnest(generate_series(0, {FOLDS - 1})) AS fold) AS f CROSS JOIN (SELECT avg(price) AS overall FROM lots) AS a
    LEFT JOIN (SELECT feature, level, fold, count(label) AS n, sum(label) AS total FROM rows_by_feature GROUP BY 1, 2, 3) AS o
        ON o.feature = t.feature AND o.level IS NOT DISTINCT FROM t.level AND o.fold = f.fold""".replace(
    "rows_by_feature", f"""(SELECT lot_order % {FOLDS} AS fold, price AS label, 'make_model_key' AS feature, make_model_key AS level FROM lots
        UNION ALL SELECT lot_order % {FOLDS}, price, 'raw_category', raw_category FROM lots) AS r"""))
def level_means_by_fold(spark, d):
    lots = i.lots(spark, d, "lot_order", "make_model_key", "raw_category", "price")
    totals = training.level_totals(lots, F.col("price"), ["make_model_key", "raw_category"], F.pmod("lot_order", F.lit(FOLDS)), FOLDS)
    return training.level_means_by_fold(totals, lots.agg(F.avg("price")).first()[0], PRIOR)


@query("price_drivers", "feature:s, importance:f6, n_splits:i")
def price_drivers(spark, d):
    return _one_model(spark, d, "log").feature_importance().limit(10)


def segments(spark, d):
    """Every category, the residual segment and every brand segment, on the training set stored by segment."""
    enriched = _enriched(spark, d)
    return fanout.stored_by_segment(fanout.category_segments(enriched, min_records=FLOOR)
                                    + fanout.make_category_segments(enriched, min_records=FLOOR))


def _segment_models(spark, d, methods=("log",)):
    held = _trained.setdefault((spark.sparkContext.applicationId, d, "segments"), {})
    missing = [m for m in methods if m not in held]
    if missing:
        models = fanout.train_segments(segments(spark, d), missing, i.TIES, CONFIG, bucket=i.bucket())
        for m in missing:
            held[m] = {k: model for k, model in models.items() if k[2] == m}
    models = {k: model for m in methods for k, model in held[m].items()}
    return models, fanout.registry(spark, models)


@query("train_segments", MODEL_SPEC)
def train_segments(spark, d):
    return _segment_models(spark, d, METHODS)[1]


def imputed_segments(spark, d):
    """Every category, on lots whose missing values are imputed, stored by segment."""
    from lotvalue.operators.filters import IMPUTED_FIELDS, require_complete
    from lotvalue.operators.impute import clean_with_imputation
    from lotvalue.plans.datasets import enrich
    cleaned = clean_with_imputation(i.raw(spark, d, *i.TIES, *MODEL_COLUMNS), AS_OF_YEAR)
    usable = require_complete(cleaned.filter("price > 0"), IMPUTED_FIELDS)
    enriched = materialize(enrich(usable, roles.catalog(spark, d, ["lot_order"]), roles.FUTURE_SYMBOLS), "imputed")
    return fanout.stored_by_segment(fanout.imputed_segments(enriched, min_records=FLOOR))


@query("train_imputed", MODEL_SPEC)
def train_imputed(spark, d):
    return fanout.registry(spark, fanout.train_segments(imputed_segments(spark, d), METHODS, i.TIES, CONFIG, bucket=i.bucket()))


@query("routed_scoring", KEY_SPEC + ", tier:s, model_key:s, prediction:f2")
def routed_scoring(spark, d):
    models, registered = _segment_models(spark, d)
    return fanout.score_routed(i.requests(spark, d), models, registered)


@query("category_scoring", KEY_SPEC + ", tier:s, model_key:s, prediction:f2")
def category_scoring(spark, d):
    models, registered = _segment_models(spark, d)
    return fanout.score_by_category(i.requests(spark, d), models, registered, "log")


@query("batch_valuation", KEY_SPEC + ", tier:s, model_key:s, is_valid:i, prediction:f2, lower:f2, upper:f2, "
       "usage_insight:s, market_sentiment:s, display_make:s")
def batch_valuation(spark, d):
    models, registered = _segment_models(spark, d)
    return value_requests(roles.requests(spark, d), models, registered, AS_OF)
