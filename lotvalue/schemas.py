"""Fixed schemas of the seven input tables and of valuation requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, StringType, StructType, TimestampNTZType,
)

TYPES = {
    "string": StringType(), "double": DoubleType(), "int": IntegerType(), "boolean": BooleanType(),
    "timestamp_ntz": TimestampNTZType(),
}


def _schema(ddl: str) -> StructType:
    schema = StructType()
    for column in ddl.split(","):
        name, kind = column.split()
        schema = schema.add(name, TYPES[kind])
    return schema


AUCTIONS = _schema("""
    make_id string, make_key string, model_id string, make_model_key string, raw_model string, raw_make string,
    raw_category string, raw_condition string, raw_hours string, raw_sold_date string, raw_price string,
    auctioneer_id string, auctioneer_key string, raw_auctioneer string, region string, state string, city string,
    zip string, serial_number string, vin string, specs string, raw_specs string, price double, year double,
    hours double, miles double, latitude double, longitude double, sold_date timestamp_ntz
""")
BAROMETER = _schema("""
    date timestamp_ntz, month string, year int, barometer double, current_conditions double,
    future_expectations double, capital_investment_index double
""")
DIESEL = _schema("month_date timestamp_ntz, price_usd_per_gallon double")
EL_NINO = _schema("date timestamp_ntz, year int, month int, value double, phase double")
FUTURES = _schema("date timestamp_ntz, future_symbol string, price double, vol double")
MAKES = _schema("""
    name string, make_key string, still_in_business boolean, headquarters_country_iso_2 string,
    production_year_start int, production_year_end int
""")
REQUESTS = _schema("""
    request_id string, make string, model string, year double, hours double, condition string, region string,
    category string, barometer double, current_conditions double, future_expectations double,
    capital_investment double, diesel_price double, el_nino double
""")


@dataclass
class Catalog:
    """The seven tables, all lazy."""

    auctions: DataFrame
    makes: DataFrame
    barometer: DataFrame
    diesel: DataFrame
    el_nino: DataFrame
    futures: DataFrame
    auctioneers: DataFrame | None = None
