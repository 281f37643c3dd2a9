"""Profiles and reports. Groups are reduced by partial aggregation; medians come from the quantile operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import month_key
from ..functions.rules import CATEGORY_RULES, OTHER, category_memberships
from .joins import lookup_join
from .quantiles import group_medians, group_quantiles, sized_group_quantiles, stored_value_counts
from .states import KLL_K, LG_BUCKETS


def _with_medians(df: DataFrame, keys: list[str], aggregates: list[Column], medians: dict,
                  approximate: bool = False) -> DataFrame:
    """Ordinary aggregates and medians of the same groups; both sides are already one row per group.

    With ``approximate`` the medians come from sketches, in the same aggregation: within 1.3 % of the ranks, and no value is counted.
    """
    kept = df.dropna(subset=keys) if keys else df
    if approximate:
        sketches = [F.kll_sketch_agg_double(c.cast("double"), KLL_K).alias(f"_{name}") for name, c in medians.items()]
        both = kept.groupBy(*keys).agg(*aggregates, *sketches)
        return both.select("*", *[F.when(F.kll_sketch_get_n_double(f"_{name}") > 0, F.kll_sketch_get_quantile_double(
            f"_{name}", F.lit(0.5))).alias(name) for name in medians]).drop(*[f"_{name}" for name in medians])
    plain = kept.groupBy(*keys).agg(*aggregates) if keys else kept.agg(*aggregates)
    exact = group_medians(kept, keys, medians)
    return plain.join(exact, keys, "left") if keys else plain.crossJoin(exact)


def monthly_sales(df: DataFrame, since: str = "2000-01-01", approximate: bool = False) -> DataFrame:
    months = df.withColumn("month", month_key(F.col("sold_date"))).filter(F.col("month") >= F.lit(since).cast("date"))
    return _with_medians(months, ["month"], [F.count("price").alias("n_sales")], {"median_price": F.col("price")}, approximate)


def yearly_sales(df: DataFrame, last: int | None = 20, approximate: bool = False) -> DataFrame:
    """Count, median and mean price per sale year, rounded half to even; the most recent ``last`` years."""
    years = df.withColumn("sale_year", F.year("sold_date"))
    out = _with_medians(years, ["sale_year"], [F.count("price").alias("n_sales"), F.avg("price").alias("mean_price")],
                        {"median_price": F.col("price")}, approximate)
    out = out.withColumns({c: F.bround(c, 0) for c in ("median_price", "mean_price")})
    return out.orderBy(F.desc("sale_year")).limit(last) if last else out


def regional_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    out = _with_medians(
        df.filter("price > 0"), ["region"],
        [F.count("price").alias("n_sales"), F.avg("price").alias("mean_price"),
         F.stddev_samp("price").alias("std_price")],
        {"median_price": F.col("price")}, approximate)
    rounded = out.withColumns({c: F.bround(c, 0) for c in ("mean_price", "median_price", "std_price")})
    return rounded.orderBy(F.desc("n_sales"), "region")


def make_stats(df: DataFrame, top: int = 20, approximate: bool = False) -> DataFrame:
    out = _with_medians(
        df.filter("price > 0"), ["make_key"],
        [F.count("price").alias("n_sales"), F.avg("price").alias("mean_price")],
        {"median_price": F.col("price"), "median_hours": F.col("hours")}, approximate)
    rounded = out.withColumns({c: F.bround(c, 0) for c in ("mean_price", "median_price", "median_hours")})
    return rounded.orderBy(F.desc("n_sales"), "make_key").limit(top)


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, non-null and null counts, coverage and distinct values: one row per column, one scan.

    Exact distinct counts come from counting (column, value) pairs: the shuffle is spread by value, and equal values
    are merged before it. With ``approximate`` there is one sketch per column and no shuffle of values.
    """
    kinds = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    if approximate:
        wide = df.agg(F.count("*").alias("total"), *[
            F.struct(F.count(c).alias("non_null"), F.approx_count_distinct(c).alias("n_distinct")).alias(f"c_{c}")
            for c in df.columns])
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c_{c}.non_null").alias("non_null"),
                                  F.col(f"c_{c}.n_distinct").alias("n_distinct")) for c in df.columns])
        counted = wide.select("total", F.inline(rows))
    else:
        texts = df.select(*[((F.col(c) + 0.0) if kind in ("double", "float") else F.col(c)).cast("string").alias(c)
                            for c, kind in df.dtypes])      # adding 0.0 makes -0.0 equal to 0.0
        values = (texts.unpivot([], df.columns, "column_name", "value")
                       .groupBy("column_name", "value").agg(F.count("*").alias("n")))
        counted = values.groupBy("column_name").agg(
            F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
            F.count("value").alias("n_distinct"))
    return counted.select(
        "column_name", kinds[F.col("column_name")].alias("dtype"), "non_null",
        (F.col("total") - F.col("non_null")).alias("null_count"),
        F.round(F.try_divide("non_null", "total") * 100, 1).alias("coverage_pct"), "n_distinct")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    plain = df.select(F.inline(pairs)).groupBy("measure").agg(
        F.count("value").alias("n_values"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    quartiles = group_quantiles(df, [], {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75]).select(
        "measure", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return plain.join(quartiles, "measure", "left")


def field_summary(df: DataFrame) -> DataFrame:
    """Price and hours above zero, range of dates and model years: one row."""
    price, hours = F.when(F.col("price") > 0, F.col("price")), F.when(F.col("hours") > 0, F.col("hours"))
    ranges = []
    for name, value in (("price", price), ("hours", hours)):
        ranges += [F.count(name).alias(f"n_{name}"), F.min(value).alias(f"min_{name}"),
                   F.max(value).alias(f"max_{name}"), F.avg(value).alias(f"mean_{name}")]
    ranges += [F.min("sold_date").alias("first_date"), F.max("sold_date").alias("last_date"),
               F.min("year").alias("min_year"), F.max("year").alias("max_year")]
    return _with_medians(df, [], ranges, {"median_price": price, "median_hours": hours})


def exploration_summary(df: DataFrame, as_of: str) -> DataFrame:
    from .filters import recent, usable

    def covered(name: str) -> Column:
        return F.avg(F.col(name).isNotNull().cast("double")).alias(f"{name}_coverage")

    return df.agg(
        F.count("*").alias("total_records"), F.min("sold_date").alias("first_date"),
        F.max("sold_date").alias("last_date"), covered("price"), covered("hours"), covered("region"),
        F.count_distinct("make_key").alias("unique_makes"), F.count_distinct("region").alias("unique_regions"),
        F.count_if(usable()).alias("usable_records"), F.count_if(usable() & recent(as_of)).alias("usable_recent"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; with ``approximate`` from one sketch each, which moves no values."""
    if approximate:
        return df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(c, LG_BUCKETS)).alias(c) for c in columns]).unpivot(
            [], columns, "field", "n_distinct")
    return df.agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], columns, "field", "n_distinct")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    # count(column) is 0 for the NULL group. A filter on a derived column would be copied down into the scan.
    counts = df.groupBy(column).agg(F.count(column).alias("n")).filter("n > 0")
    ordered = counts.orderBy(F.desc("n"), column)
    return ordered.limit(top) if top else ordered


def month_count_summary(df: DataFrame) -> DataFrame:
    """Months covered, and mean, least and most sales per month."""
    per_month = (df.filter(F.col("sold_date").isNotNull()).groupBy(month_key(F.col("sold_date")).alias("month"))
                   .agg(F.count("*").alias("n")))
    return per_month.agg(F.count("*").alias("months"), F.avg("n").alias("mean_sales"), F.min("n").alias("min_sales"),
                         F.max("n").alias("max_sales"))


def seasonality(df: DataFrame) -> DataFrame:
    months = df.withColumn("sale_month", F.month("sold_date"))
    return group_medians(months, ["sale_month"], {"median_price": F.col("price")})


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing count and percentage of each column that has any, most first."""
    counted = df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"n_{c}") for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.col("total") - F.col(f"n_{c}")).alias("missing_count"),
                 F.round(F.try_divide(F.col("total") - F.col(f"n_{c}"), F.col("total")) * 100, 1).alias("missing_pct"))
        for c in columns])
    return (counted.select(F.inline(rows)).filter("missing_count > 0")
                   .orderBy(F.desc("missing_count"), "feature"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; the last bin includes its upper edge.

    Every bin is reported, empty ones with a zero. One scan for the range, one for the counts.
    """
    values = df.select(value.cast("double").alias("value")).filter(F.col("value").isNotNull())
    edges = values.agg(F.min("value").alias("low"), F.max("value").alias("high")).filter(F.col("low").isNotNull())
    width = (F.col("high") - F.col("low")) / bins
    number = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / width),
                                                         F.lit(bins - 1))).otherwise(0).cast("int")
    counts = (values.crossJoin(F.broadcast(edges)).withColumn("bin", number)
                    .groupBy("bin").agg(F.count("*").alias("n")))
    grid = edges.select("low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def box_plot(df: DataFrame, key: str, value: str, whisker: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group."""
    rows = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    tally = stored_value_counts(rows, [key], {value: F.col(value)})      # joined below: one row per distinct value
    found, size = sized_group_quantiles(rows, [key], {value: F.col(value)}, [0.25, 0.5, 0.75], counted=tally)
    quartiles = found.select(key, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"),
                             F.col("n_values").alias("_weight"))
    reach = (F.col("q3") - F.col("q1")) * whisker
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    joined = lookup_join(tally, quartiles, [key], size, weight="_weight")
    return joined.groupBy(key, "q1", "median", "q3").agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"))


def dataset_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows, range of the price and of its logarithm, median price, date range; per group if keys are given."""
    return _with_medians(df, keys or [], [
        F.count("*").alias("n_rows"), F.min("price").alias("min_price"), F.max("price").alias("max_price"),
        F.min("sold_date").alias("first_date"), F.max("sold_date").alias("last_date"),
        F.min(F.when(F.col("price") > 0, F.log("price"))).alias("min_log_price"),
        F.max(F.when(F.col("price") > 0, F.log("price"))).alias("max_log_price"),
    ], {"median_price": F.col("price")})


def makes_overview(makes: DataFrame) -> DataFrame:
    return makes.agg(F.count("*").alias("n_makes"),
                     F.sum(F.col("still_in_business").cast("int")).alias("n_in_business"))


def makes_sample(makes: DataFrame, n: int = 10) -> DataFrame:
    """The first makes by key, with what is known of them."""
    return makes.orderBy("make_key", "name").limit(n)


def reference_lists(df: DataFrame, rules=CATEGORY_RULES) -> DataFrame:
    """Distinct makes and regions per category, one row per value; 'other' lists those of all lots.

    Category membership here is the training filter, so a lot may count for several categories.
    """
    keys = F.concat(F.coalesce(category_memberships(F.col("raw_category"), rules), F.array().cast("array<string>")),
                    F.array(F.lit(OTHER.key)))
    pairs = F.array(F.struct(F.lit("make").alias("kind"), F.col("make_key").alias("value")),
                    F.struct(F.lit("region").alias("kind"), F.col("region").alias("value")))
    return (df.select("make_key", "region", "raw_category").distinct()
              .select(F.explode(keys).alias("category_key"), "make_key", "region")
              .select("category_key", F.inline(pairs))
              .filter(F.col("value").isNotNull()).distinct())


def top_models(df: DataFrame, top: int = 100, rules=CATEGORY_RULES) -> DataFrame:
    """The first ``top`` model names, in string order, of every (category, make).

    Spark limits each task to ``top`` rows per group before the shuffle, so a large group stays small.
    """
    names = (df.select("raw_category", "make_key", F.col("raw_model").alias("model")).distinct()
               .select(F.explode(category_memberships(F.col("raw_category"), rules)).alias("category_key"),
                       "make_key", "model")
               .filter(F.col("make_key").isNotNull() & F.col("model").isNotNull() & (F.col("model") != ""))
               .distinct())
    w = Window.partitionBy("category_key", "make_key").orderBy("model")
    return names.withColumn("model_no", F.row_number().over(w)).filter(F.col("model_no") <= top)


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """min(n, rows) rows, chosen by a hash of their key: the same rows on every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys).limit(n)


def total_sort(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*order)


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def date_ranges(series: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last date of each series and the number of its dates; series by name, with their date column."""
    rows = [table.agg(F.lit(name).alias("series"), F.count(c).alias("n_values"), F.min(c).alias("first_date"),
                      F.max(c).alias("last_date")) for name, (table, c) in series.items()]
    return reduce(DataFrame.unionByName, rows)
