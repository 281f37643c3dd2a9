"""Role views: the seven input tables derived from the star-schema test tables.

Each auction column names the dimensions it needs, and ``auctions`` joins only those, so a query over three
fact columns scans the fact table alone. The expressions are SQL text because the checks use the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..schemas import Catalog

HORSEPOWER = "cast(100 + 10 * p_size AS string)"
MODEL_SLUG = "concat(lower(p_type), '-', cast(p_size AS string))"

# column -> (expression, dimensions it reads)
AUCTION_COLUMNS = {
    "lot_order": ("l_orderkey", ()),
    "lot_line": ("cast(l_linenumber AS bigint)", ()),
    "lot_part": ("l_partkey", ()),
    "lot_seller": ("l_suppkey", ()),
    "lot_ref": ("l_extendedprice", ()),
    "sold_date": ("l_shipdate", ()),
    "hours": ("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE (l_quantity - 2) * 2500 END", ()),
    "model_id": ("CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE cast(l_partkey AS string) END", ()),
    "raw_price": (
        "CASE l_linenumber WHEN 1 THEN concat(cast(cast(l_quantity AS int) AS string), 'd') WHEN 2 THEN '1,234' "
        "WHEN 3 THEN '' WHEN 4 THEN concat(' ', cast(cast(l_quantity AS int) AS string), chr(9)) WHEN 5 THEN NULL "
        "WHEN 6 THEN '-2.50' ELSE cast(cast(l_quantity AS int) * 100 AS string) END", ()),
    "price": (
        "CASE WHEN l_quantity = 1 AND l_linenumber = 7 THEN NULL "
        "WHEN l_quantity = 1 AND l_linenumber = 6 THEN -1.0 * p_retailprice "
        "ELSE p_retailprice * l_quantity * (1 - l_discount) END", ("part",)),
    "make_key": (
        "CASE p_brand WHEN 'Brand#1' THEN ' John-Deere ' WHEN 'Brand#2' THEN 'FORD' "
        "WHEN 'Brand#3' THEN concat('case-ih', chr(9)) WHEN 'Brand#4' THEN 'Chevrolet' "
        "WHEN 'Brand#5' THEN 'New-Holland' WHEN 'Brand#8' THEN 'None' ELSE p_brand END", ("part",)),
    "make_model_key": (
        f"CASE p_brand WHEN 'Brand#1' THEN concat('john-deere-', {MODEL_SLUG}) "
        f"WHEN 'Brand#2' THEN concat('Ford-', {MODEL_SLUG}) WHEN 'Brand#3' THEN concat(' case-ih-', {MODEL_SLUG}) "
        f"WHEN 'Brand#4' THEN concat('chevrolet-', {MODEL_SLUG}) "
        f"WHEN 'Brand#5' THEN concat('new-holland-', {MODEL_SLUG}) WHEN 'Brand#8' THEN 'NA-NA' "
        f"ELSE concat(lower(p_brand), '-', {MODEL_SLUG}) END", ("part",)),
    "raw_model": ("concat(p_type, ' ', cast(p_size AS string))", ("part",)),
    "raw_category": (
        "CASE WHEN p_name = 'cold plate' THEN NULL ELSE "
        "replace(replace(replace(replace(replace(replace(replace(replace(p_name, 'ring', 'Tractors'), "
        "'gear', 'Truck Tractor'), 'gizmo', 'Trucks and Trailers'), 'rod', 'Combine Harvesting'), "
        "'widget', 'Loaders and Lifts'), 'anvil', 'Excavator'), 'bolt', 'Sprayer'), 'plate', 'Hay and Forage') END",
        ("part",)),
    "year": ("CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE cast(1945 + p_size AS double) END", ("part",)),
    "specs": (
        "CASE l_linenumber WHEN 1 THEN '{bad' WHEN 2 THEN NULL "
        f"WHEN 3 THEN concat('{{\"horsepower\"=>\"', {HORSEPOWER}, '\", \"drive\"=>\"4 Wheel Drive\", "
        "\"features\"=>[\"cab\", \"GPS guidance\"], \"attachments\"=>[\"loader\", \"bucket\"]}') "
        f"WHEN 4 THEN concat('{{\"horsepower\"=>\"', {HORSEPOWER}, 'hp\", \"drive\"=>\"2WD\", "
        "\"features\"=>[\"Air ride\"], \"attachments\"=>[]}') "
        f"ELSE concat('{{\"horsepower\"=>', {HORSEPOWER}, ', \"drive\"=>nil}}') END", ("part",)),
    "raw_condition": (
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Like New' WHEN '2-HIGH' THEN ' VERY GOOD' "
        "WHEN '3-MEDIUM' THEN 'Average' WHEN '5-LOW' THEN 'Salvage' END", ("orders",)),
    "region": ("concat(' ', r_name)", ("orders", "customer", "nation", "region")),
    "state": ("n_name", ("orders", "customer", "nation")),
}

# The same for valuation requests: one request per lot, with empty and out-of-range fields.
REQUEST_COLUMNS = {
    **{key: AUCTION_COLUMNS[key] for key in ("lot_order", "lot_line", "lot_part", "lot_seller", "lot_ref")},
    "make": ("CASE p_brand WHEN 'Brand#1' THEN 'john-deere' WHEN 'Brand#2' THEN 'ford' WHEN 'Brand#3' THEN 'case-ih' "
             "WHEN 'Brand#4' THEN 'chevrolet' WHEN 'Brand#5' THEN 'new-holland' ELSE lower(p_brand) END", ("part",)),
    "model": ("CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '(Any Model)' "
              "ELSE concat(p_type, '_', cast(p_size AS string)) END", ("part",)),
    "year": ("CASE WHEN l_linenumber = 5 THEN NULL ELSE cast(1955 + p_size AS double) END", ("part",)),
    "hours": ("(l_quantity - 2) * 1250", ()),
    "condition": ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Excellent' WHEN '2-HIGH' THEN 'Good' "
                  "WHEN '3-MEDIUM' THEN 'Fair' WHEN '5-LOW' THEN 'Salvage' END", ("orders",)),
    "region": ("lower(r_name)", ("orders", "customer", "nation", "region")),
    "category": AUCTION_COLUMNS["raw_category"],
    "barometer": ("CASE WHEN l_linenumber = 3 THEN NULL ELSE 40 + l_quantity * 4 END", ()),
    "diesel_price": ("CASE WHEN l_linenumber = 4 THEN NULL ELSE 0.5 + l_discount * 100 END", ()),
}

# Columns that read one dimension only. They are computed on its rows, before the join.
OWNERS = {
    "make_key": "part", "make_model_key": "part", "raw_model": "part", "raw_category": "part", "make": "part",
    "category": "part", "raw_condition": "orders", "condition": "orders", "state": "nation", "region": "region",
}

# dimension -> (its key, the key that points at it)
DIMENSIONS = {
    "part": ("p_partkey", "l_partkey"),
    "orders": ("o_orderkey", "l_orderkey"),
    "customer": ("c_custkey", "o_custkey"),
    "nation": ("n_nationkey", "c_nationkey"),
    "region": ("r_regionkey", "n_regionkey"),
}
LOT_KEYS = ["lot_order", "lot_line", "lot_part", "lot_seller", "lot_ref"]

MAKES_SQL = """
    SELECT p_brand AS name,
           CASE p_brand WHEN 'Brand#1' THEN 'John-Deere' WHEN 'Brand#2' THEN 'Ford ' WHEN 'Brand#3' THEN 'case-ih'
                WHEN 'Brand#4' THEN 'chevrolet' WHEN 'Brand#5' THEN 'new-holland' ELSE p_brand END AS make_key,
           CASE WHEN min(p_partkey) % 3 = 0 THEN 0 ELSE 1 END AS still_in_business,
           CASE WHEN min(p_partkey) % 2 = 0 THEN 'US' ELSE 'DE' END AS headquarters_country_iso_2,
           1900 AS production_year_start,
           CASE WHEN min(p_partkey) % 3 = 0 THEN 1996 END AS production_year_end
    FROM {part} WHERE p_brand <> 'Brand#7' GROUP BY p_brand
"""
BAROMETER_SQL = """
    SELECT cast(date_trunc('month', o_orderdate) AS date) AS date, avg(o_totalprice) / 1000 AS barometer,
           min(o_totalprice) / 1000 AS current_conditions, max(o_totalprice) / 1000 AS future_expectations,
           count(*) / cast(3.0 AS double) AS capital_investment_index
    FROM {orders} GROUP BY cast(date_trunc('month', o_orderdate) AS date)
"""
DIESEL_SQL = """
    SELECT cast(date_trunc('month', o_orderdate) AS date) AS month_date,
           1 + count(*) / cast(100.0 AS double) AS price_usd_per_gallon
    FROM {orders} GROUP BY cast(date_trunc('month', o_orderdate) AS date)
"""
EL_NINO_SQL = """
    SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, avg(o_totalprice) AS value,
           cast(count(*) % 3 AS double) AS phase
    FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)
"""
FUTURES_SQL = """
    SELECT cast(o_orderdate AS date) AS date, substr(o_orderpriority, 3) AS future_symbol, o_totalprice AS price
    FROM {orders}
"""
FUTURE_SYMBOLS = ["HIGH", "LOW", "MEDIUM", "NOT SPECIFIED", "URGENT"]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is read from the file once per session, not once per scan."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _view(spark: SparkSession, sf_dir: str, available: dict, columns: list[str] | None) -> DataFrame:
    columns = columns or list(available)
    needed = {dim for c in columns for dim in available[c][1]}
    owned = {c: OWNERS[c] for c in columns if c in OWNERS}

    def dimension(dim: str) -> DataFrame:
        extra = [f"{available[c][0]} AS {c}" for c, owner in owned.items() if owner == dim]
        return table(spark, sf_dir, dim).selectExpr("*", *extra)

    def joined(df: DataFrame, dim: str, to: DataFrame) -> DataFrame:
        key, pointer = DIMENSIONS[dim]
        return df.join(to, F.col(key) == F.col(pointer), "left")

    # The lots are the widest rows and move as seldom and as narrow as they can: orders get their customers first, the
    # texts of parts come after, and those of the two smallest tables last.
    df = table(spark, sf_dir, "lineitem")
    if "orders" in needed:
        orders = dimension("orders")
        df = joined(df, "orders", joined(orders, "customer", dimension("customer")) if "customer" in needed else orders)
    for dim in ("part", "nation", "region"):
        if dim in needed:
            df = joined(df, dim, dimension(dim))
    return df.selectExpr(*[c if c in owned else f"{available[c][0]} AS {c}" for c in columns])


def auctions(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Auction lots with the named columns (all by default), joining only the dimensions those need."""
    return _view(spark, sf_dir, AUCTION_COLUMNS, columns)


def requests(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return _view(spark, sf_dir, REQUEST_COLUMNS, columns)


def _derived(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    return spark.sql(text, **{name: table(spark, sf_dir, name)})


def makes(spark, sf_dir) -> DataFrame:
    return _derived(spark, sf_dir, MAKES_SQL, "part")


def barometer(spark, sf_dir) -> DataFrame:
    return _derived(spark, sf_dir, BAROMETER_SQL, "orders")


def diesel(spark, sf_dir) -> DataFrame:
    return _derived(spark, sf_dir, DIESEL_SQL, "orders")


def el_nino(spark, sf_dir) -> DataFrame:
    return _derived(spark, sf_dir, EL_NINO_SQL, "orders")


def futures(spark, sf_dir) -> DataFrame:
    return _derived(spark, sf_dir, FUTURES_SQL, "orders")


def catalog(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> Catalog:
    return Catalog(
        auctions=auctions(spark, sf_dir, columns), makes=makes(spark, sf_dir), barometer=barometer(spark, sf_dir),
        diesel=diesel(spark, sf_dir), el_nino=el_nino(spark, sf_dir), futures=futures(spark, sf_dir),
        auctioneers=table(spark, sf_dir, "supplier"),
    )
