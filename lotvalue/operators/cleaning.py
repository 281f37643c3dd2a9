"""Typing, range checks and key standardisation of auction lots and valuation requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import coerce_number, coerce_timestamp, strip_lower, text_key, within

MIN_YEAR = 1950
MAX_HOURS = 100_000


def cleaned_columns(df: DataFrame, as_of_year: int) -> dict[str, Column]:
    """The cleaned form of every column the cleaner knows and the input has."""
    types = dict(df.dtypes)

    def number(name: str) -> Column:
        return coerce_number(F.col(name), types[name])

    rules = {
        "sold_date": lambda: coerce_timestamp(F.col("sold_date"), types["sold_date"]),
        "price": lambda: number("price"),
        "hours": lambda: within(number("hours"), 0, MAX_HOURS),
        "year": lambda: within(number("year"), MIN_YEAR, as_of_year + 1),
        "region": lambda: text_key(F.col("region")),
        "state": lambda: text_key(F.col("state"), upper=True),
        "make_key": lambda: text_key(F.col("make_key")),
        "make_model_key": lambda: text_key(F.col("make_model_key"), also_missing=("na-na",)),
    }
    return {name: rule() for name, rule in rules.items() if name in types}


def clean_auctions(df: DataFrame, as_of_year: int) -> DataFrame:
    """One projection; no row is dropped. ``as_of_year`` bounds the model year from above."""
    return df.withColumns(cleaned_columns(df, as_of_year))


def invalid_price_count(cleaned: DataFrame) -> DataFrame:
    """How many lots have no usable price. They are counted, not dropped."""
    bad = (F.col("price") <= 0) | F.col("price").isNull()
    return cleaned.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_invalid"))


def standardise_makes(makes: DataFrame) -> DataFrame:
    return makes.withColumn("make_key", strip_lower(F.col("make_key")))


# What a valuation request takes when the field is empty.
REQUEST_DEFAULTS = {
    "condition": "Good",
    "barometer": 100.0,
    "current_conditions": 95.0,
    "future_expectations": 105.0,
    "capital_investment": 80.0,
    "diesel_price": 3.5,
    "el_nino": 0.0,
}
ANY_MODEL = "(Any Model)"


def request_model_key(make: Column, model: Column) -> Column:
    """'make-model' with the model lower-cased and dashed; 'make-na' when no model is named."""
    named = model.isNotNull() & ~model.isin("", ANY_MODEL)
    slug = F.translate(F.lower(model), " _", "--")
    return F.concat(make, F.lit("-"), F.when(named, slug).otherwise("na"))


def prepare_requests(requests: DataFrame, as_of: str) -> DataFrame:
    """Valuation requests as feature-pipeline input: keys built, empty fields defaulted."""
    def filled(name: str) -> Column:
        default = F.lit(REQUEST_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in requests.columns else default

    known = {"make", "model", "year", "hours", "region", "category", *REQUEST_DEFAULTS}
    carried = [F.col(c) for c in requests.columns if c not in known]
    named = F.col("model").isNotNull() & ~F.col("model").isin("", ANY_MODEL)
    return requests.select(
        *carried,
        F.lit(as_of).cast("timestamp_ntz").alias("sold_date"),
        F.col("year").cast("double").alias("year"),
        F.col("hours").cast("double").alias("hours"),
        filled("condition").alias("raw_condition"),
        F.col("make").alias("make_key"),
        request_model_key(F.col("make"), F.col("model")).alias("make_model_key"),
        F.when(named, F.col("model")).otherwise("Unknown").alias("raw_model"),
        F.col("region"),
        F.col("category").alias("raw_category"),
        filled("barometer").alias("barometer"),
        filled("current_conditions").alias("current_conditions"),
        filled("future_expectations").alias("future_expectations"),
        filled("capital_investment").alias("capital_investment_index"),
        filled("diesel_price").alias("diesel_price"),
        filled("el_nino").alias("el_nino_phase"),
        F.lit(None).cast("int").alias("make_production_year_end"),
    )


# Ranges and choices the request form accepts (model year is bounded by as_of + 1 as well).
REQUEST_RANGES = {"hours": (0, 50_000), "barometer": (50, 200), "diesel_price": (1, 10)}
REQUEST_MIN_YEAR = 1980
REQUEST_CONDITIONS = ("Excellent", "Good", "Fair", "Poor")


def validate_requests(prepared: DataFrame, as_of_year: int) -> DataFrame:
    """Adds one ok_* flag per rule and ``is_valid``; an empty field fails its rule."""
    rules = {"ok_year": F.col("year").between(REQUEST_MIN_YEAR, as_of_year + 1),
             "ok_condition": F.col("raw_condition").isin(*REQUEST_CONDITIONS)}
    rules |= {f"ok_{name}": F.col(name).between(*bounds) for name, bounds in REQUEST_RANGES.items()}
    flags = {name: F.coalesce(rule, F.lit(False)).cast("int") for name, rule in rules.items()}
    valid = F.least(*[F.col(name) for name in flags])
    return prepared.withColumns(flags).withColumn("is_valid", valid)
