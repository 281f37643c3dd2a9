"""Left equi joins with dimensions, monthly series and fitted lookup tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import month_key
from ..session import BROADCAST_MAX_BYTES, materialize
from .cleaning import standardise_makes

HOT_SHARE = 0.001      # a key holding more than this share of all rows is spread over several tasks
HOT_SALTS = 64

MAKE_COLUMNS = {
    "name": "make_name",
    "still_in_business": "make_still_in_business",
    "headquarters_country_iso_2": "make_country",
    "production_year_start": "make_production_year_start",
    "production_year_end": "make_production_year_end",
}


def row_bytes(df: DataFrame) -> Column:
    """Memory a row takes, from above: 16 bytes per column and the length of its texts."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in df.dtypes if kind == "string"]
    return reduce(lambda a, b: a + b, texts, F.lit(16 * len(df.columns))).cast("bigint")


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def lookup_join(fact: DataFrame, lookup: DataFrame, on: list[str], size: int, weight: str | None = None,
                max_broadcast: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Left join with a lookup table whose size in bytes was measured.

    A table of at most ``max_broadcast`` bytes is broadcast and the fact rows stay where they are. A larger one
    is joined by shuffle. Then the rows of hot keys, and rows without a key, are spread by a hash of the whole
    row, and the lookup rows of hot keys are repeated once per salt. ``weight`` names the lookup column that
    holds the number of fact rows per key; at most 1/HOT_SHARE keys can exceed that share of the total, which
    bounds the broadcast of hot keys.
    """
    if size <= max_broadcast:
        return fact.join(F.broadcast(lookup), on, "left")
    if weight is None:
        return fact.join(lookup, on, "left")   # Spark's own skew-join handling splits large partitions

    total = lookup.agg(F.sum(weight).alias("_total"))
    hot = (lookup.crossJoin(F.broadcast(total))
                 .filter(F.col(weight) > F.col("_total") * HOT_SHARE)
                 .select(*on, F.lit(True).alias("_hot")))
    no_key = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in on))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns]), F.lit(HOT_SALTS)).cast("int")
    salted = fact.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | no_key, spread).otherwise(0)).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = (lookup.join(F.broadcast(hot), on, "left")
                    .withColumn("_salt", F.explode(salts)).drop("_hot"))
    return salted.join(copies, [*on, "_salt"], "left").drop("_salt")


def _sized(table: DataFrame, label: str) -> tuple[DataFrame, int]:
    stored = materialize(table, label)
    return stored, table_bytes(stored)


def makes_dimension(makes: DataFrame) -> DataFrame:
    """make_key plus the renamed columns that are joined to lots; the key is trimmed and lower-cased."""
    table = standardise_makes(makes)
    return table.select("make_key", *[F.col(c).alias(n) for c, n in MAKE_COLUMNS.items() if c in table.columns])


def join_makes(lots: DataFrame, makes: DataFrame) -> DataFrame:
    """Left join on make_key. Duplicate keys in ``makes`` multiply rows; see ``duplicate_keys``."""
    dimension, size = _sized(makes_dimension(makes), "makes")
    return lookup_join(lots, dimension, ["make_key"], size)


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: empty for a proper dimension."""
    return table.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def barometer_by_month(barometer: DataFrame) -> DataFrame:
    wanted = ["barometer", "current_conditions", "future_expectations", "capital_investment_index"]
    return barometer.select(month_key(F.col("date")).alias("month_key"),
                            *[c for c in wanted if c in barometer.columns])


def diesel_by_month(diesel: DataFrame) -> DataFrame:
    return diesel.select(month_key(F.col("month_date")).alias("month_key"),
                         F.col("price_usd_per_gallon").alias("diesel_price"))


def el_nino_by_month(el_nino: DataFrame) -> DataFrame:
    """The key is built from the year and month numbers."""
    return el_nino.select(F.make_date("year", "month", F.lit(1)).alias("month_key"),
                          F.col("value").alias("el_nino_value"), F.col("phase").alias("el_nino_phase"))


def futures_monthly_mean(futures: DataFrame) -> DataFrame:
    return (futures.withColumn("month_key", month_key(F.col("date")))
                   .filter(F.col("month_key").isNotNull() & F.col("future_symbol").isNotNull())
                   .groupBy("month_key", "future_symbol").agg(F.avg("price").alias("mean_price")))


def futures_by_month(futures: DataFrame, symbols: list[str]) -> DataFrame:
    """Monthly mean per symbol, one column per symbol. Naming the symbols saves the scan that would find them."""
    means = futures_monthly_mean(futures).groupBy("month_key").pivot("future_symbol", symbols).agg(
        F.first("mean_price"))
    return means.select("month_key", *[
        F.col(f"`{s}`").alias(f"{s.lower().replace(' ', '_')}_price") for s in symbols
    ])


def list_symbols(futures: DataFrame) -> list[str]:
    """Distinct symbols, each of which becomes a column. Name the symbols where they are known: it saves this scan."""
    return sorted(r[0] for r in futures.select("future_symbol").distinct().dropna().collect())


def macro_calendar(barometer=None, diesel=None, el_nino=None, futures=None,
                   symbols: list[str] | None = None) -> DataFrame | None:
    """All monthly series side by side, keyed by month. A series without its key column is skipped.

    Joining the small series to each other first means the lots are joined once, not four times; a month that
    occurs twice in a series still multiplies the lots of that month, as joining one by one would.
    """
    series = []
    if barometer is not None and "date" in barometer.columns:
        series.append(barometer_by_month(barometer))
    if diesel is not None and "month_date" in diesel.columns:
        series.append(diesel_by_month(diesel))
    if el_nino is not None and {"year", "month"} <= set(el_nino.columns):
        series.append(el_nino_by_month(el_nino))
    if futures is not None and "future_symbol" in futures.columns:
        series.append(futures_by_month(futures, symbols or list_symbols(futures)))
    if not series:
        return None
    return reduce(lambda a, b: a.join(b, "month_key", "full"), series)


def join_calendar(lots: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """Left join of lots with a table keyed by month_key."""
    keyed = lots.withColumn("month_key", month_key(F.col("sold_date")))
    if calendar is None:
        return keyed
    stored, size = _sized(calendar, "calendar")
    return lookup_join(keyed, stored, ["month_key"], size)


def join_macro(lots: DataFrame, barometer=None, diesel=None, el_nino=None, futures=None,
               symbols: list[str] | None = None) -> DataFrame:
    return join_calendar(lots, macro_calendar(barometer, diesel, el_nino, futures, symbols))


def match_counts(joined: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows that found a partner, per source, in one pass over the joined lots."""
    return joined.agg(F.count("*").alias("n_rows"),
                      *[F.count(column).alias(f"n_{source}") for source, column in columns.items()])
