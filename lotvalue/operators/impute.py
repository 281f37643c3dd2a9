"""Filling missing values from group medians, most specific group first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import coerce_number, coerce_timestamp, share, text_key, within
from ..session import materialize
from .cleaning import MAX_HOURS, MIN_YEAR
from .joins import lookup_join
from .quantiles import sized_group_quantiles, stacked

MEDIAN_AGE = 7          # fixed value: age assumed where the model year is missing
EVERYTHING = "*"


def median_levels(df: DataFrame, levels: dict, value: str, weight: str | None = None,
                  **options) -> tuple[DataFrame, int]:
    """(level, key) -> median for several groupings in one scan, and the size of that table in bytes.

    ``levels`` maps a level name to its key column; a literal key gives the median over everything.
    """
    variants = [[F.lit(n).alias("level"), k.cast("string").alias("key")] for n, k in levels.items()]
    rows = stacked(df, variants, [value] + ([weight] if weight else []))
    found, size = sized_group_quantiles(rows, ["level", "key"], {value: F.col(value)}, [0.5], weight=weight, **options)
    return found.select("level", "key", F.col("q0").alias("median"), "n_values"), size


def join_level(df: DataFrame, medians: DataFrame, size: int, level: str, on: str, name: str,
               keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds the level's median as column ``name``. ``keys``: columns that tell several sets of medians apart."""
    table = medians.filter(F.col("level") == level).select(
        *keys, F.col("key").alias(on), F.col("median").alias(name), F.col("n_values").alias("_weight"))
    return lookup_join(df, table, [*keys, on], size, weight="_weight").drop("_weight")


def group_median_column(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The median of ``value`` within the row's group, on every row of the group."""
    medians, size = median_levels(df, {"group": F.col(key)}, value)
    return join_level(df, medians, size, "group", key, name)


def _overall(medians: DataFrame, name: str) -> DataFrame:
    return medians.agg(F.max(F.when(F.col("level") == "all", F.col("median"))).alias(name))


def impute_hours(df: DataFrame, keep_parts: bool = False) -> DataFrame:
    """Own hours, else the median of the make-model, of the category, of everything."""
    levels = {"category": F.col("raw_category"), "all": F.lit(EVERYTHING)}
    if "make_model_key" in df.columns:
        levels["model"] = F.col("make_model_key")
    medians, size = median_levels(df, levels, "hours")
    filled = df
    if "model" in levels:
        filled = join_level(filled, medians, size, "model", "make_model_key", "hours_by_model")
    else:
        filled = filled.withColumn("hours_by_model", F.lit(None).cast("double"))
    filled = join_level(filled, medians, size, "category", "raw_category", "hours_by_category")
    filled = filled.crossJoin(F.broadcast(_overall(medians, "hours_overall")))      # one row
    filled = filled.withColumn("hours", F.coalesce("hours", "hours_by_model", "hours_by_category", "hours_overall"))
    return filled if keep_parts else filled.drop("hours_by_model", "hours_by_category", "hours_overall")


def impute_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.coalesce("year", F.year("sold_date") - MEDIAN_AGE).cast("double"))


def clean_with_imputation(df: DataFrame, as_of_year: int, standardise_make: bool = False) -> DataFrame:
    """Type, impute, then null what is out of range and standardise keys, in that order.

    Medians are therefore taken over raw keys and unchecked hours, and a value nulled by the range check is not
    imputed again. ``make_key`` is left as it is unless asked for.
    """
    types = dict(df.dtypes)
    typed = df.withColumns({
        "sold_date": coerce_timestamp(F.col("sold_date"), types["sold_date"]),
        "price": coerce_number(F.col("price"), types["price"]),
        "year": coerce_number(F.col("year"), types["year"]),
        "hours": coerce_number(F.col("hours"), types["hours"]),
    })
    imputed = impute_hours(impute_year(typed))
    checked = {"hours": within(F.col("hours"), 0, MAX_HOURS),
               "year": within(F.col("year"), MIN_YEAR, as_of_year + 1)}
    if "region" in types:
        checked["region"] = text_key(F.col("region"))
    if "make_model_key" in types:
        checked["make_model_key"] = text_key(F.col("make_model_key"), also_missing=("na-na",))
    if standardise_make and "make_key" in types:
        checked["make_key"] = text_key(F.col("make_key"))
    return imputed.withColumns(checked)


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """Percentage of rows with a value, one row per field."""
    counted = df.agg(*[share(F.col(f).isNotNull()).alias(f) for f in fields])
    return counted.unpivot([], fields, "field", "coverage_pct")


def horsepower_medians(df: DataFrame) -> tuple[DataFrame, int]:
    """Medians of parsed horsepower by make-model, and by category after the make-model fill.

    The lots are reduced to counts once; both levels are computed from the counts. A level whose column is absent has
    no rows.
    """
    names = ["make_model_key", "raw_category"]
    present = [c for c in names if c in df.columns]
    counts = df.groupBy(*present, "horsepower").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumns({c: F.lit(None).cast("string") for c in names if c not in present}), "horsepower")
    by_model, size_model = median_levels(counts, {"model": F.col("make_model_key")}, "horsepower", weight="n")
    filled = join_level(counts, by_model, size_model, "model", "make_model_key", "_model")
    filled = filled.withColumn("horsepower", F.coalesce("horsepower", "_model"))
    by_category, size_category = median_levels(filled, {"category": F.col("raw_category")}, "horsepower", weight="n")
    return by_model.unionByName(by_category), max(size_model, size_category)


def cascade_horsepower(df: DataFrame, medians: DataFrame, size: int, default: float,
                       keys: tuple[str, ...] = ()) -> DataFrame:
    filled, found = df, ["horsepower"]
    for level, on in (("model", "make_model_key"), ("category", "raw_category")):
        if on in df.columns:
            filled = join_level(filled, medians, size, level, on, f"_hp_{level}", keys)
            found.append(f"_hp_{level}")
    return filled.withColumn("horsepower", F.coalesce(*found, F.lit(default))).drop(*found[1:])


def hours_by_make_and_age(df: DataFrame) -> DataFrame:
    """Fills hours with the median of lots of the same make and age; documented as an alternative."""
    pair = F.concat_ws("|", "make_key", F.col("equipment_age").cast("string"))
    keyed = df.withColumn("_make_age", F.when(F.col("make_key").isNotNull() & F.col("equipment_age").isNotNull(), pair))
    medians, size = median_levels(keyed, {"make_age": F.col("_make_age")}, "hours")
    joined = join_level(keyed, medians, size, "make_age", "_make_age", "hours_make_age")
    return joined.withColumn("hours_imputed", F.coalesce("hours", "hours_make_age")).drop("_make_age")
