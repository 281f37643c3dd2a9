"""Registered queries over files: the role views written as the exports a user has, read back by the readers and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotvalue.plans.datasets import training_dataset
from lotvalue.session import new_path
from lotvalue.sources import readers, roles, sinks

from . import inputs as i
from .registry import query
from .sql import AS_OF_YEAR, HIGH, LOW, MIN_DATE

SEPARATORS = {"tsv": "\t", "csv": ","}


def export(df, path: str, fmt: str) -> str:
    """A folder of files with headers, or of Parquet; white space and empty texts are kept as they are.

    Delimited text is compressed, as large exports are: it is most of what these queries write.
    """
    if fmt == "parquet":
        df.write.parquet(path)
    else:
        (df.write.option("sep", SEPARATORS[fmt]).option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).option("compression", "gzip").csv(path))
    return path


LOT_COLUMNS = ["sold_date", "price", "hours", "year", "make_key", "make_model_key", "raw_model", "raw_category", "raw_price",
               "region", "state"]
#: Layouts of the parts: which lots, and their columns. Parts lack columns, order them differently or have further ones.
LAYOUTS = [("lot_line <= 2", LOT_COLUMNS), ("lot_line IN (3, 4)", [c for c in LOT_COLUMNS if c not in ("hours", "state")]),
           ("lot_line = 5", LOT_COLUMNS[::-1]), ("lot_line > 5", [*LOT_COLUMNS, "lot_order"])]


def export_lots(spark, sf_dir: str, folder: str, fmt: str, extension: str) -> str:
    lots = i.raw(spark, sf_dir, "lot_line", "lot_order", *LOT_COLUMNS)
    for n, (some, columns) in enumerate(LAYOUTS):
        export(lots.filter(some).select(*columns), f"{folder}/auction_results_part{n}.{extension}", fmt)
    return f"{folder}/auction_results_part*.{extension}"


PARTS_SPEC = ("make_key:s, raw_category:s, n_rows:i, n_hours:i, n_state:i, n_raw_price:i, sum_cents:i, max_hours:f2, first_sale:d, "
              "last_sale:d, first_model:s")
PARTS_SQL = """
    SELECT make_key, raw_category, count(*) AS n_rows, count(hours) AS n_hours, count(state) AS n_state,
        count({raw_price}) AS n_raw_price, sum(floor(price * 100)) AS sum_cents, max(hours) AS max_hours, min(sold_date) AS first_sale,
        max(sold_date) AS last_sale, min(make_model_key) AS first_model
    FROM (SELECT * REPLACE (CASE WHEN lot_line NOT IN (3, 4) THEN hours END AS hours,
                            CASE WHEN lot_line NOT IN (3, 4) THEN state END AS state) FROM raw_lots) AS t GROUP BY ALL"""


def parts_report(lots):
    return lots.groupBy("make_key", "raw_category").agg(
        F.count("*").alias("n_rows"), F.count("hours").alias("n_hours"), F.count("state").alias("n_state"),
        F.count("raw_price").alias("n_raw_price"), F.sum(F.floor(F.col("price") * 100)).alias("sum_cents"), F.max("hours").alias("max_hours"),
        F.min("sold_date").alias("first_sale"), F.max("sold_date").alias("last_sale"), F.min("make_model_key").alias("first_model"))


@query("scan_parts", PARTS_SPEC, PARTS_SQL.format(raw_price="nullif(raw_price, '')"))
def scan_parts(spark, d):
    """Parts of delimited text in four layouts, united by the names in their headers. An empty field is missing."""
    return parts_report(readers.read_parts(spark, [export_lots(spark, d, new_path(spark, "parts"), "tsv", "csv")], "tsv"))


@query("scan_parquet_parts", PARTS_SPEC, PARTS_SQL.format(raw_price="raw_price"))
def scan_parquet_parts(spark, d):
    return parts_report(readers.read_parts(
        spark, [export_lots(spark, d, new_path(spark, "parts"), "parquet", "parquet")], "parquet"))


BAROMETER = "date:d, barometer:f4, current_conditions:f4, future_expectations:f4, capital_investment_index:f4"


@query("scan_barometer", BAROMETER, "SELECT * FROM barometer")
def scan_barometer(spark, d):
    return readers.read_barometer(spark, export(roles.barometer(spark, d), new_path(spark, "barometer"), "tsv"))


@query("scan_diesel", "month_date:d, price_usd_per_gallon:f4", "SELECT * FROM diesel")
def scan_diesel(spark, d):
    return readers.read_diesel(spark, export(roles.diesel(spark, d), new_path(spark, "diesel"), "csv"), "csv")


@query("scan_el_nino", "year:i, month:i, value:f4, phase:f1", "SELECT * FROM el_nino")
def scan_el_nino(spark, d):
    return readers.read_el_nino(spark, export(roles.el_nino(spark, d), new_path(spark, "el_nino"), "tsv"))


@query("scan_futures", "date:d, future_symbol:s, price:f2", "SELECT * FROM futures")
def scan_futures(spark, d):
    return readers.read_futures(spark, export(roles.futures(spark, d), new_path(spark, "futures"), "csv"), "csv")


@query("scan_future_symbols", "future_symbol:s", "SELECT DISTINCT future_symbol FROM futures")
def scan_future_symbols(spark, d):
    path = export(roles.futures(spark, d), new_path(spark, "futures"), "tsv")
    return readers.future_symbols(readers.read_futures(spark, path))


MAKES = "name:s, make_key:s, still_in_business:i, headquarters_country_iso_2:s, production_year_start:i, production_year_end:i"


@query("scan_makes", MAKES, "SELECT * FROM makes")
def scan_makes(spark, d):
    """Of two exports the first by name is read."""
    folder = new_path(spark, "makes")
    export(roles.makes(spark, d), f"{folder}/makes_1.csv", "tsv")
    export(roles.makes(spark, d).limit(3), f"{folder}/makes_2.csv", "tsv")
    return readers.read_makes(spark, readers.first_match(spark, f"{folder}/makes*.csv"))


@query("scan_auctioneers", "s_suppkey:i, s_name:s, s_nationkey:i", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def scan_auctioneers(spark, d):
    """A table without a fixed schema: its columns are those of its header."""
    return readers.read_auctioneers(spark, export(roles.table(spark, d, "supplier"), new_path(spark, "auctioneers"), "tsv"))


def export_catalog(spark, sf_dir: str, fmt: str, lots=None) -> str:
    """All seven tables under one folder, under the names a catalog is loaded by. ``lots``: the auctions, if they are stored already."""
    folder, extension = new_path(spark, "catalog"), "parquet" if fmt == "parquet" else "csv"
    lots = i.raw(spark, sf_dir, *LOT_COLUMNS) if lots is None else lots
    export(lots, f"{folder}/auction_results_part1.{extension}", fmt)
    for name, role in {"makes_1": roles.makes, "ag_economy_barometers": roles.barometer, "diesel_prices": roles.diesel,
                       "el_nino_readings": roles.el_nino, "future_prices": roles.futures}.items():
        export(role(spark, sf_dir), f"{folder}/{name}.{extension}", fmt)
    export(roles.table(spark, sf_dir, "supplier"), f"{folder}/auctioneers_1.{extension}", fmt)
    return folder


COUNTED = {"auctions": "raw_lots", "makes": "makes", "barometer": "barometer", "diesel": "diesel", "el_nino": "el_nino",
           "futures": "futures", "auctioneers": "supplier"}


@query("load_catalog", "fmt:s, table_name:s, n_rows:i", " UNION ALL ".join(
    f"SELECT '{fmt}' AS fmt, '{name}' AS table_name, count(*) AS n_rows FROM {source}"
    for fmt in ("tsv", "parquet") for name, source in COUNTED.items()))
def load_catalog(spark, d):
    """Both formats. The lots are joined once: their text is exported from their Parquet export."""
    out, stored = None, export_catalog(spark, d, "parquet")
    lots = spark.read.parquet(f"{stored}/auction_results_part1.parquet")
    for fmt, folder in (("tsv", export_catalog(spark, d, "tsv", lots)), ("parquet", stored)):
        catalog = readers.load_catalog(spark, folder, fmt)
        for name in COUNTED:
            rows = getattr(catalog, name).agg(F.count("*").alias("n_rows")).select(
                F.lit(fmt).alias("fmt"), F.lit(name).alias("table_name"), "n_rows")
            out = rows if out is None else out.unionByName(rows)
    return out


STORED_SPEC = "sale_year:i, make_key:s, n_sales:i, sum_cents:i, mean_barometer:f4, mean_diesel:f4, n_makes:i"
STORED_SQL = """SELECT year(sold_date) AS sale_year, make_key, count(*) AS n_sales, sum(floor(price * 100)) AS sum_cents,
    avg(barometer) AS mean_barometer, avg(diesel_price) AS mean_diesel, count(make_name) AS n_makes FROM training {where} GROUP BY ALL"""


def by_year(table):
    return table.groupBy("sale_year", "make_key").agg(
        F.count("*").alias("n_sales"), F.sum(F.floor(F.col("price") * 100)).alias("sum_cents"), F.avg("barometer").alias("mean_barometer"),
        F.avg("diesel_price").alias("mean_diesel"), F.count("make_name").alias("n_makes"))


def _training_from_files(spark, d):
    """The training set of the files of a catalog: readers, cleaning, filters and joins."""
    catalog = readers.load_catalog(spark, export_catalog(spark, d, "tsv"), "tsv")
    return training_dataset(catalog, AS_OF_YEAR, roles.FUTURE_SYMBOLS, sinks.by_sale_year, min_date=MIN_DATE, min_price=LOW, max_price=HIGH)


@query("training_sink", STORED_SPEC, STORED_SQL.format(where="WHERE year(sold_date) >= 1998"))
def training_sink(spark, d):
    """Written by sale year; a filter on the year reads no other folder."""
    path = new_path(spark, "training_data")
    sinks.write_arranged(_training_from_files(spark, d), path)
    return by_year(spark.read.parquet(path).filter("sale_year >= 1998"))


@query("build_once", STORED_SPEC, STORED_SQL.format(where=""))
def build_once(spark, d):
    """Built by the first call; the second finds inputs and parameters as they were, and scans."""
    path, files = new_path(spark, "built"), new_path(spark, "lots")
    parts = [export(i.lots(spark, d, "sold_date", "price", "make_key", "lot_order"), files, "parquet")]
    params = {"min_date": MIN_DATE, "low": LOW, "high": HIGH}
    sinks.read_or_build(spark, path, lambda: i.training(spark, d), inputs=parts, params=params)

    def never():
        raise AssertionError("built twice")
    return by_year(sinks.read_or_build(spark, path, never, inputs=parts, params=params))


@query("feature_sink", "make_key:s, region:s, n_rows:i, sum_hours:f1, mean_price:f4",
       "SELECT make_key, region, count(*) AS n_rows, sum(hours) AS sum_hours, avg(price) AS mean_price FROM lots GROUP BY ALL")
def feature_sink(spark, d):
    """Written as Parquet; the scan takes the first of the paths that exists."""
    path = new_path(spark, "features")
    sinks.write_features(i.lots(spark, d, "make_key", "region", "hours", "price"), path)
    return readers.first_existing(spark, [f"{path}-of-another-run", path]).groupBy("make_key", "region").agg(
        F.count("*").alias("n_rows"), F.sum("hours").alias("sum_hours"), F.avg("price").alias("mean_price"))
