"""Input tables of the registered queries, built from the role views with the check parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lotvalue.operators.cleaning import clean_auctions, prepare_requests
from lotvalue.operators.filters import filter_training
from lotvalue.operators.ranking import time_split
from lotvalue.operators.routing import registry_from_scores, route, with_model_info
from lotvalue.functions.rules import OTHER, category_key, make_category_key
from lotvalue.plans.datasets import TRAINING_FIELDS, enrich
from lotvalue.session import materialize
from lotvalue.sources import roles

from .sql import AS_OF, AS_OF_YEAR, HIGH, LOW, MIN_DATE

TIES = ["lot_order", "lot_line", "lot_part", "lot_seller", "lot_ref"]
ID = ["lot_order", "lot_line", "lot_part", "lot_seller"]


def bucket():
    """Cells of a day by order number, the same in both engines."""
    return F.pmod(F.col("lot_order"), F.lit(64))


def raw(spark, sf_dir, *columns: str) -> DataFrame:
    return roles.auctions(spark, sf_dir, list(columns) or None)


def clean(spark, sf_dir, *columns: str) -> DataFrame:
    return clean_auctions(raw(spark, sf_dir, *columns), AS_OF_YEAR)


def lots(spark, sf_dir, *columns: str) -> DataFrame:
    """Cleaned lots inside the training filter, with the named columns and those the filter reads."""
    wanted = list(dict.fromkeys([*columns, *TRAINING_FIELDS])) if columns else []
    return filter_training(clean(spark, sf_dir, *wanted), min_price=LOW, max_price=HIGH, min_date=MIN_DATE,
                           require=TRAINING_FIELDS)


def training(spark, sf_dir, *columns: str) -> DataFrame:
    return enrich(lots(spark, sf_dir, *columns), roles.catalog(spark, sf_dir, ["lot_order"]), roles.FUTURE_SYMBOLS)


def stored_training(spark, sf_dir, *columns: str) -> DataFrame:
    """The training set written once, for steps that read it several times."""
    return materialize(training(spark, sf_dir, *columns), "training")


def split_lots(spark, sf_dir, *columns: str) -> DataFrame:
    return time_split(lots(spark, sf_dir, *TIES, *columns), "sold_date", TIES, bucket=bucket())


def scored(spark, sf_dir, *columns: str) -> DataFrame:
    """Split lots with a stand-in prediction, so that SQL can check what is computed from predictions."""
    factor = 0.8 + 0.02 * F.col("lot_line") + 0.001 * (F.col("lot_part") % 50)
    return split_lots(spark, sf_dir, *columns).withColumn("prediction", F.col("price") * factor)


def by_method(spark, sf_dir) -> DataFrame:
    """Stand-in predictions of both methods, once for each model a lot belongs to."""
    rows = scored(spark, sf_dir, "raw_category")
    category = category_key(F.col("raw_category"))
    brand = make_category_key(F.col("make_key"), F.col("raw_category"))
    models = F.array_compact(F.array(
        F.struct(F.when(F.col("_category") == OTHER.key, "generic").otherwise("category").alias("tier"),
                 F.col("_category").alias("model_key")),
        F.when(F.col("_brand").isNotNull(),
               F.struct(F.lit("make_category").alias("tier"), F.col("_brand").alias("model_key")))))
    methods = F.array(F.struct(F.lit("log").alias("method"), F.col("prediction").alias("prediction")),
                      F.struct(F.lit("regular").alias("method"),
                               (F.col("price") * (0.7 + 0.05 * F.col("lot_line"))).alias("prediction")))
    return (rows.withColumns({"_category": category, "_brand": brand})
                .select("split", "price", "lot_line", "prediction", F.inline(models))
                .select("split", "price", "tier", "model_key", F.inline(methods)))


def registry(spark, sf_dir, min_train: int = 60) -> DataFrame:
    """Registry of the stand-in models. It has one row per rule and method and is read several times: stored."""
    return materialize(registry_from_scores(by_method(spark, sf_dir)).filter(F.col("n_train") >= min_train),
                       "registry")


def requests(spark, sf_dir, *columns: str) -> DataFrame:
    names = list(dict.fromkeys([*TIES, "make", "model", "year", "hours", "condition", "region", "category",
                                "barometer", "diesel_price", *columns]))
    return prepare_requests(roles.requests(spark, sf_dir, names), AS_OF)


def priced(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Routed requests with a stand-in price, and the registry they were routed by."""
    known = registry(spark, sf_dir)
    routed = with_model_info(route(requests(spark, sf_dir), known), known)
    price = 9000 + 100 * (F.col("lot_part") % 97) + 50.0 * F.col("lot_line")
    return routed.withColumn("prediction", price), known
