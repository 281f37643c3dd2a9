"""The SQL that DuckDB runs on the same tables to check each registered query."""

from __future__ import annotations

import re

from lotvalue.functions.columns import WHITESPACE
from lotvalue.sources import roles

from .shape import shaped_sql

AS_OF_YEAR = 2002
AS_OF = "2002-01-01"
MIN_DATE = "1997-01-01"
LOW, HIGH = 5000, 45000
KEYS = "lot_order, lot_line, lot_part, lot_seller"
KEY_SPEC = "lot_order:i, lot_line:i, lot_part:i, lot_seller:i"
ORDER = "lot_order % 64, lot_order, lot_line, lot_part, lot_seller, lot_ref"

# All white space that text keys are stripped of.
WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def _view(columns: dict) -> str:
    return ("SELECT " + ", ".join(f"{e} AS {n}" for n, (e, _) in columns.items())
            + " FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN orders ON o_orderkey = l_orderkey"
              " LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey"
              " LEFT JOIN region ON r_regionkey = n_regionkey")


def _key(name: str, fold: str = "lower", missing: str = "'nan', 'none', ''") -> str:
    text = f"lower(trim({name}, {WS}))"
    return f"CASE WHEN {text} NOT IN ({missing}) THEN {fold}({text}) END"


def _any(name: str, terms: list[str]) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower({name}), '{t}')" for t in terms) + ", false)"


TRACTOR, TRUCK = ["tractor"], ["truck", "trailer"]
HARVEST, LOADER = ["harvest", "combine"], ["loader", "lift", "skid steer"]
CONSTRUCTION, APPLICATOR = ["construction", "excavator", "dozer", "backhoe"], ["applicator", "sprayer"]
PLANTING, HAY = ["planting", "planter"], ["hay", "forage", "baler"]
BY_CATEGORY = {"tractors": TRACTOR, "trucks_and_trailers": TRUCK, "harvesting": HARVEST, "loaders_and_lifts": LOADER,
               "construction": CONSTRUCTION, "applicators": APPLICATOR}
BY_BRAND = [("john-deere_tractors", "john-deere", TRACTOR), ("john-deere_harvesting", "john-deere", HARVEST),
            ("john-deere_planting", "john-deere", PLANTING), ("john-deere_hay_forage", "john-deere", HAY),
            ("ford_trucks", "ford", TRUCK), ("ford_tractors", "ford", TRACTOR),
            ("case-ih_tractors", "case-ih", TRACTOR), ("case-ih_harvesting", "case-ih", HARVEST),
            ("chevrolet_trucks", "chevrolet", TRUCK), ("new-holland_tractors", "new-holland", TRACTOR),
            ("new-holland_hay_forage", "new-holland", HAY)]
CATEGORY_KEY = "CASE " + " ".join(
    f"WHEN {_any('raw_category', t)} THEN '{k}'" for k, t in BY_CATEGORY.items()) + " ELSE 'other' END"
_SPELLED = f"concat(lower(trim(make_key, {WS})), '_', replace(replace(lower(trim(raw_category, {WS})), ' ', '_'), 'and', ''))"
MAKE_CATEGORY_KEY = (
    f"CASE WHEN make_key IS NOT NULL AND raw_category IS NOT NULL AND {_SPELLED} IN ("
    + ", ".join(f"'{k}'" for k, _, _ in BY_BRAND) + f") THEN {_SPELLED} "
    + " ".join(f"WHEN lower(trim(make_key, {WS})) = '{m}' AND {_any('raw_category', t)} THEN '{k}'"
               for k, m, t in BY_BRAND) + " END")
GRADE = (f"CASE WHEN lower(trim(raw_condition, {WS})) IN ('excellent', 'like new') THEN 'excellent' "
         f"WHEN lower(trim(raw_condition, {WS})) IN ('fair', 'average') THEN 'fair' "
         f"WHEN lower(trim(raw_condition, {WS})) IN ('poor', 'needs work', 'salvage') THEN 'poor' ELSE 'good' END")
MONTH = "cast(date_trunc('month', sold_date) AS date)"
COMPLETE = ("price IS NOT NULL AND sold_date IS NOT NULL AND make_model_key IS NOT NULL AND year IS NOT NULL "
            "AND hours IS NOT NULL AND region IS NOT NULL")
HP_TEXT = "json_extract_string(specs_json, '$.horsepower')"
PRICE_COLUMNS = [s.lower().replace(" ", "_") + "_price" for s in roles.FUTURE_SYMBOLS]

CTES = {
    "raw_lots": _view(roles.AUCTION_COLUMNS),
    "raw_requests": _view(roles.REQUEST_COLUMNS),
    "clean": f"""
        SELECT * REPLACE (
            CASE WHEN hours BETWEEN 0 AND 100000 THEN hours END AS hours,
            CASE WHEN year BETWEEN 1950 AND {AS_OF_YEAR + 1} THEN year END AS year,
            {_key('region')} AS region, {_key('state', 'upper')} AS state, {_key('make_key')} AS make_key,
            {_key('make_model_key', missing="'nan', 'none', '', 'na-na'")} AS make_model_key)
        FROM raw_lots""",
    "lots": f"""SELECT * FROM clean WHERE price BETWEEN {LOW} AND {HIGH} AND sold_date >= '{MIN_DATE}'
                AND make_key IS NOT NULL""",
    "makes": roles.MAKES_SQL.format(part="part"),
    "makes_dim": """SELECT lower(trim(make_key)) AS make_key, name AS make_name, still_in_business AS
        make_still_in_business, headquarters_country_iso_2 AS make_country, production_year_start AS
        make_production_year_start, production_year_end AS make_production_year_end FROM makes""",
    "barometer": roles.BAROMETER_SQL.format(orders="orders"),
    "diesel": roles.DIESEL_SQL.format(orders="orders"),
    "el_nino": roles.EL_NINO_SQL.format(orders="orders"),
    "futures": roles.FUTURES_SQL.format(orders="orders"),
    "futures_mean": """SELECT cast(date_trunc('month', date) AS date) AS month_key, future_symbol,
        avg(price) AS mean_price FROM futures GROUP BY ALL""",
    "futures_wide": "SELECT month_key, " + ", ".join(
        f"max(CASE WHEN future_symbol = '{s}' THEN mean_price END) AS {c}"
        for s, c in zip(roles.FUTURE_SYMBOLS, PRICE_COLUMNS)) + " FROM futures_mean GROUP BY month_key",
    "training": f"""
        SELECT lots.*, makes_dim.* EXCLUDE (make_key), {MONTH} AS month_key, b.* EXCLUDE (date),
               d.price_usd_per_gallon AS diesel_price, e.value AS el_nino_value, e.phase AS el_nino_phase,
               f.* EXCLUDE (month_key)
        FROM lots LEFT JOIN makes_dim ON lots.make_key = makes_dim.make_key
        LEFT JOIN barometer AS b ON b.date = {MONTH} LEFT JOIN diesel AS d ON d.month_date = {MONTH}
        LEFT JOIN el_nino AS e ON make_date(e.year, e.month, 1) = {MONTH}
        LEFT JOIN futures_wide AS f ON f.month_key = {MONTH}""",
    # hours imputation
    "imputed": f"""
        SELECT r.* REPLACE (
            coalesce(r.year, cast(year(r.sold_date) - 7 AS double)) AS year,
            coalesce(r.hours, m.h, c.h, o.h) AS hours), m.h AS hours_by_model, c.h AS hours_by_category
        FROM raw_lots AS r
        LEFT JOIN (SELECT make_model_key AS k, median(hours) AS h FROM raw_lots GROUP BY 1) AS m
            ON r.make_model_key = m.k
        LEFT JOIN (SELECT raw_category AS k, median(hours) AS h FROM raw_lots GROUP BY 1) AS c ON r.raw_category = c.k
        CROSS JOIN (SELECT median(hours) AS h FROM raw_lots) AS o""",
    "imputed_clean": f"""
        SELECT * REPLACE (
            CASE WHEN hours BETWEEN 0 AND 100000 THEN hours END AS hours,
            CASE WHEN year BETWEEN 1950 AND {AS_OF_YEAR + 1} THEN year END AS year, {_key('region')} AS region,
            {_key('make_model_key', missing="'nan', 'none', '', 'na-na'")} AS make_model_key) FROM imputed""",
    # features
    "spec_rows": """SELECT *, CASE WHEN json_valid(j) THEN j END AS specs_json FROM (
        SELECT *, replace(replace(specs, '=>', ':'), 'nil', 'null') AS j FROM training) AS t""",
    "hp0": f"SELECT * EXCLUDE (j), TRY_CAST({HP_TEXT} AS double) AS hp FROM spec_rows",
    "hp1": """SELECT hp0.*, coalesce(hp, m.h) AS hp_model FROM hp0 LEFT JOIN (
        SELECT make_model_key AS k, median(hp) AS h FROM hp0 GROUP BY 1) AS m ON make_model_key = m.k""",
    "hp2": """SELECT hp1.*, coalesce(hp_model, c.h, 150.0) AS horsepower FROM hp1 LEFT JOIN (
        SELECT raw_category AS k, median(hp_model) AS h FROM hp1 GROUP BY 1) AS c ON raw_category = c.k""",
    "aged": f"""SELECT *, CASE WHEN year IS NOT NULL THEN least(greatest(year(sold_date) - year, 0), 50) END
        AS equipment_age, {GRADE} AS condition FROM hp2""",
    "used": """SELECT *, CASE WHEN h IS NOT NULL THEN least(h, 2000) END AS hours_per_year FROM (
        SELECT *, CASE WHEN equipment_age > 0 THEN hours / equipment_age ELSE hours END AS h FROM aged) AS t""",
    "equipped": """SELECT *,
        CASE condition WHEN 'excellent' THEN 5.0 WHEN 'fair' THEN 3.0 WHEN 'poor' THEN 2.0 ELSE 4.0 END
            AS condition_score,
        CASE WHEN hours_per_year IS NULL THEN 'normal' WHEN hours_per_year <= 0 THEN NULL
             WHEN hours_per_year <= 300 THEN 'light' WHEN hours_per_year <= 600 THEN 'normal'
             WHEN hours_per_year <= 1000 THEN 'heavy' ELSE 'extreme' END AS utilization_bucket,
        CASE WHEN make_production_year_end IS NULL THEN 1 ELSE 0 END AS is_current_production,
        CASE WHEN make_production_year_end IS NULL THEN 0.0
             ELSE greatest(year(sold_date) - make_production_year_end, 0) END AS years_since_discontinued FROM used""",
    "stats": """SELECT avg(barometer) AS barometer_mean, stddev_samp(barometer) AS barometer_std,
        avg(diesel_price) AS diesel_mean FROM training""",
    "levels": """SELECT 'make_model_key' AS feature, make_model_key AS level, count(*) AS n FROM training
            WHERE make_model_key IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'region', region, count(*) FROM training WHERE region IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'raw_category', raw_category, count(*) FROM training WHERE raw_category IS NOT NULL
            GROUP BY ALL
        UNION ALL SELECT 'raw_model', raw_model, count(*) FROM training WHERE raw_model IS NOT NULL GROUP BY ALL""",
    "features": """
        SELECT e.* REPLACE (
                CASE WHEN lm.n >= 20 THEN e.make_model_key ELSE 'other' END AS make_model_key,
                CASE WHEN lr.n >= 20 THEN e.region ELSE 'other' END AS region,
                CASE WHEN lc.n >= 20 THEN e.raw_category ELSE 'other' END AS raw_category),
            month(sold_date) AS sale_month, quarter(sold_date) AS sale_quarter, year(sold_date) AS sale_year,
            sin(2 * pi() * month(sold_date) / 12) AS month_sin, cos(2 * pi() * month(sold_date) / 12) AS month_cos,
            CASE WHEN month(sold_date) IN (2, 3, 4, 5) THEN 1 ELSE 0 END AS is_planting_season,
            CASE WHEN month(sold_date) IN (8, 9, 10, 11) THEN 1 ELSE 0 END AS is_harvest_season,
            (barometer - barometer_mean) / barometer_std AS barometer_norm,
            future_expectations - current_conditions AS sentiment_spread,
            capital_investment_index / 100 AS investment_confidence, diesel_price / diesel_mean AS diesel_relative,
            coalesce(lm.n, 1) AS make_volume, ln(1 + coalesce(lm.n, 1)) AS log_make_volume,
            coalesce(lo.n, 1) AS model_volume, ln(1 + coalesce(lo.n, 1)) AS log_model_volume
        FROM equipped AS e CROSS JOIN stats
        LEFT JOIN levels AS lm ON lm.feature = 'make_model_key' AND lm.level = e.make_model_key
        LEFT JOIN levels AS lr ON lr.feature = 'region' AND lr.level = e.region
        LEFT JOIN levels AS lc ON lc.feature = 'raw_category' AND lc.level = e.raw_category
        LEFT JOIN levels AS lo ON lo.feature = 'raw_model' AND lo.level = e.raw_model""",
    # split, scores, registry
    "ranked": f"""SELECT *, row_number() OVER (ORDER BY cast(sold_date AS date), {ORDER}) AS position,
        count(*) OVER () AS total FROM lots""",
    "split_lots": """SELECT *, CASE
        WHEN position <= floor(total * (1::double - 0.15::double - 0.15::double)) THEN 'train'
        WHEN position <= floor(total * (1::double - 0.15::double)) THEN 'val' ELSE 'test' END AS split FROM ranked""",
    "scored": """SELECT *, price * (0.8::double + 0.02::double * lot_line + 0.001::double * (lot_part % 50)) AS prediction FROM split_lots""",
    "tiered": f"""
        SELECT t.*, s.tier, s.model_key FROM scored AS t JOIN (
            SELECT {KEYS}, lot_ref, CASE WHEN {CATEGORY_KEY} = 'other' THEN 'generic' ELSE 'category' END AS tier,
                   {CATEGORY_KEY} AS model_key FROM scored
            UNION ALL
            SELECT {KEYS}, lot_ref, 'make_category', {MAKE_CATEGORY_KEY} FROM scored
            WHERE {MAKE_CATEGORY_KEY} IS NOT NULL) AS s USING ({KEYS}, lot_ref)""",
    "by_method": """SELECT * EXCLUDE (prediction), 'log' AS method, prediction FROM tiered
        UNION ALL SELECT * EXCLUDE (prediction), 'regular', price * (0.7::double + 0.05::double * lot_line) FROM tiered""",
    "model_metrics": """SELECT tier, model_key, method, split, count(*) AS n,
        sqrt(avg((price - prediction) * (price - prediction))) AS rmse,
        avg(abs(price - prediction) / abs(price)) * 100 AS mape,
        1 - sum((price - prediction) * (price - prediction)) / nullif(var_pop(price) * count(price), 0) AS r2
        FROM by_method GROUP BY ALL""",
    "registry": "SELECT tier, model_key, method, " + ", ".join(
        [f"coalesce(max(CASE WHEN split = '{s}' THEN n END), 0) AS n_{s}" for s in ("train", "val", "test")]
        + [f"max(CASE WHEN split = '{s}' THEN {m} END) AS {s}_{m}" for s in ("val", "test")
           for m in ("rmse", "mape", "r2")]) + " FROM model_metrics GROUP BY ALL HAVING n_train >= 60",
    # requests
    "requests": f"""
        SELECT {KEYS}, lot_ref, cast('{AS_OF}' AS timestamp) AS sold_date, year, hours,
            coalesce(condition, 'Good') AS raw_condition, make AS make_key,
            concat(make, '-', CASE WHEN model IS NULL OR model IN ('', '(Any Model)') THEN 'na'
                ELSE replace(replace(lower(model), ' ', '-'), '_', '-') END) AS make_model_key,
            CASE WHEN model IS NULL OR model IN ('', '(Any Model)') THEN 'Unknown' ELSE model END AS raw_model,
            region, category AS raw_category, coalesce(barometer, 100.0) AS barometer, 95.0 AS current_conditions,
            105.0 AS future_expectations, 80.0 AS capital_investment_index,
            coalesce(diesel_price, 3.5) AS diesel_price, 0.0 AS el_nino_phase FROM raw_requests""",
    "routed": f"""
        SELECT q.*, coalesce(m.model_key, c.model_key, g.model_key) AS model_key,
            CASE WHEN m.model_key IS NOT NULL THEN 'make_category' WHEN c.model_key IS NOT NULL THEN 'category'
                 WHEN g.model_key IS NOT NULL THEN 'generic' END AS tier
        FROM (SELECT *, {MAKE_CATEGORY_KEY} AS mk, {CATEGORY_KEY} AS ck FROM requests) AS q
        LEFT JOIN registry AS m ON m.method = 'log' AND m.tier = 'make_category' AND m.model_key = q.mk
        LEFT JOIN registry AS c ON c.method = 'log' AND c.tier = 'category' AND c.model_key = q.ck
        LEFT JOIN registry AS g ON g.method = 'log' AND g.tier = 'generic' AND g.model_key = 'other'""",
    "priced": """
        SELECT r.*, 9000 + 100 * (lot_part % 97) + 50.0 * lot_line AS prediction, l.n_train, l.test_mape, l.test_r2
        FROM routed AS r LEFT JOIN registry AS l ON l.method = 'log' AND l.tier = r.tier
            AND l.model_key = r.model_key""",
    "both_methods": """
        SELECT p.*, 'log' AS method, 'regular' AS other_method,
            CASE WHEN lot_line = 7 THEN 0 ELSE 9500 + 90 * (lot_part % 97) END AS other_prediction,
            o.test_mape AS other_test_mape
        FROM priced AS p JOIN registry AS o ON o.method = 'regular' AND o.tier = p.tier
            AND o.model_key = p.model_key""",
    "trend": f"""
        SELECT {KEYS}, make_model_key, rolling_mean, CASE WHEN make_model_key IS NOT NULL THEN
            rolling_mean - lag(rolling_mean, 6) OVER (PARTITION BY make_model_key ORDER BY cast(sold_date AS date), {ORDER})
            END AS momentum
        FROM (SELECT *, CASE WHEN make_model_key IS NOT NULL THEN avg(price) OVER (PARTITION BY make_model_key
            ORDER BY cast(sold_date AS date), {ORDER} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END
            AS rolling_mean FROM clean) AS t""",
}
_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def _uses(text: str) -> list[str]:
    """Names of CTEs that a FROM or JOIN of the text reads."""
    return [m.group(2) for m in re.finditer(r"\b(FROM|JOIN)\s+(\w+)", text) if m.group(2) in CTES]


def with_ctes(text: str) -> str:
    needed: list[str] = []

    def visit(name: str) -> None:
        if name not in needed:
            for inner in _uses(CTES[name]):
                visit(inner)
            needed.append(name)

    for name in _uses(text):
        visit(name)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    return f"WITH {head} {text}" if needed else text


def coverage_rows(table: str, fields: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS field, avg(CASE WHEN {f} IS NOT NULL THEN 1.0::double ELSE 0 END) * 100 AS coverage_pct "
        f"FROM {table}" for f in fields)


def funnel_rows(table: str, steps: list[tuple[str, str]]) -> str:
    parts, reached = [], "true"
    for i, (name, condition) in enumerate(steps, 1):
        before, reached = reached, f"{reached} AND ({condition})"
        parts.append(f"SELECT {i} AS step_no, '{name}' AS step, count(*) FILTER ({reached}) AS rows_left, "
                     f"count(*) FILTER ({before}) - count(*) FILTER ({reached}) AS rows_removed FROM {table}")
    return " UNION ALL ".join(parts)


def profile_rows(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS null_count, "
        f"round(count({c})::double / count(*) * 100, 1) AS coverage_pct, count(DISTINCT {c}) AS n_distinct "
        f"FROM {table}" for c, kind in columns.items())


def summary_rows(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS measure, count({c}) AS n_values, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS minimum, "
        f"max({c}) AS maximum, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, "
        f"quantile_cont({c}, 0.75) AS q75 FROM {table}" for c in columns)


def histogram_rows(table: str, value: str, where: str, bins: int) -> str:
    return f"""
        SELECT g.bin, low + g.bin * width AS lower, low + (g.bin + 1) * width AS upper, coalesce(c.n, 0) AS n
        FROM (SELECT min({value}) AS low, (max({value}) - min({value})) / {bins} AS width FROM {table} WHERE {where}) AS e
        CROSS JOIN (SELECT unnest(range({bins})) AS bin) AS g
        LEFT JOIN (SELECT least(cast(floor(({value} - low) / width) AS int), {bins - 1}) AS bin, count(*) AS n
            FROM {table} CROSS JOIN (SELECT min({value}) AS low, (max({value}) - min({value})) / {bins} AS width
                FROM {table} WHERE {where}) AS e2 WHERE {where} AND {value} IS NOT NULL GROUP BY 1) AS c
        ON c.bin = g.bin"""


def top_counts(table: str, column: str, top: int | None) -> str:
    limit = f" LIMIT {top}" if top else ""
    return (f"SELECT '{column}' AS field, cast({column} AS varchar) AS value, n FROM (SELECT {column}, count(*) AS n "
            f"FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1{limit}) AS t")


def missing_rows(table: str, columns: list[str]) -> str:
    inner = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing_count, "
        f"round((count(*) - count({c}))::double / count(*) * 100, 1) AS missing_pct FROM {table}" for c in columns)
    return f"SELECT * FROM ({inner}) AS t WHERE missing_count > 0"


def finish(query: str, spec: str) -> str:
    return with_ctes(shaped_sql(query, spec))
