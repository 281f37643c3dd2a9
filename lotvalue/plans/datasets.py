"""Whole datasets, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.rules import CategoryRule
from ..operators.cleaning import clean_auctions
from ..operators.filters import (
    IMPUTED_FIELDS, filter_category, filter_make_category, filter_other, filter_training, require_complete,
    training_steps,
)
from ..operators.impute import clean_with_imputation
from ..operators.joins import join_macro, join_makes
from ..schemas import Catalog

TRAINING_START = "2018-01-01"
TRAINING_FIELDS = ("price", "sold_date", "make_key")


def enrich(lots: DataFrame, catalog: Catalog, symbols: list[str] | None = None) -> DataFrame:
    """Makes and monthly series on every lot: two joins on the lots."""
    return join_macro(join_makes(lots, catalog.makes), catalog.barometer, catalog.diesel, catalog.el_nino,
                      catalog.futures, symbols)


def training_lots(catalog: Catalog, as_of_year: int, min_date: str | None = TRAINING_START,
                  max_date: str | None = None, min_price=1_000, max_price=2_000_000) -> DataFrame:
    return filter_training(clean_auctions(catalog.auctions, as_of_year), min_price=min_price, max_price=max_price,
                           min_date=min_date, max_date=max_date, require=TRAINING_FIELDS)


def training_dataset(catalog: Catalog, as_of_year: int, symbols: list[str] | None = None,
                     arrange: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Clean, filter, join makes, join the monthly series. ``arrange`` places the lots before the joins, while they are narrow."""
    lots = training_lots(catalog, as_of_year, **options)
    return enrich(arrange(lots) if arrange else lots, catalog, symbols)


def _since(lots: DataFrame, min_date: str | None) -> DataFrame:
    if not min_date:
        return lots
    return lots.filter(dict(training_steps(lots, min_date=min_date))["min_date"])


def category_lots(cleaned: DataFrame, rule: CategoryRule, min_date: str | None = TRAINING_START) -> DataFrame:
    return require_complete(filter_category(_since(cleaned, min_date), rule))


def other_lots(cleaned: DataFrame, min_date: str | None = TRAINING_START) -> DataFrame:
    return filter_other(_since(cleaned, min_date))


def make_category_lots(cleaned: DataFrame, make: str, category: str, min_date: str | None = TRAINING_START,
                       min_price=5_000, max_price=500_000) -> DataFrame:
    return require_complete(filter_make_category(_since(cleaned, min_date), make, category, min_price, max_price))


def imputed_lots(auctions: DataFrame, rule: CategoryRule, as_of_year: int,
                 min_date: str | None = TRAINING_START) -> DataFrame:
    cleaned = clean_with_imputation(auctions, as_of_year)
    return require_complete(filter_category(_since(cleaned, min_date), rule), IMPUTED_FIELDS)


def imputed_dataset(catalog: Catalog, rule: CategoryRule, as_of_year: int, symbols: list[str] | None = None,
                    min_date: str | None = TRAINING_START) -> DataFrame:
    """Imputed lots of a category with makes and the monthly series joined: what imputed models are trained on."""
    return enrich(imputed_lots(catalog.auctions, rule, as_of_year, min_date), catalog, symbols)
