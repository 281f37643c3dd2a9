"""Row filters and the one-pass reports about them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import contains_any, share
from ..functions.rules import (
    CATEGORY_RULES, MAKE_CATEGORY_TERMS, OTHER, CategoryRule, category_key, make_category_key,
)

COMPLETE_FIELDS = ("price", "sold_date", "make_model_key", "year", "hours", "region")
IMPUTED_FIELDS = ("price", "sold_date", "make_model_key", "region")
OTHER_FIELDS = ("price", "sold_date", "make_key", "year", "hours", "region")


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def training_steps(df: DataFrame, min_price=1_000, max_price=2_000_000, min_date: str | None = None,
                   max_date: str | None = None, require: Iterable[str] = ()) -> list[tuple[str, Column]]:
    """The named conditions of the training filter, in order. Required fields the table lacks are skipped."""
    steps = [("price", F.col("price").between(min_price, max_price))]
    if min_date:
        steps.append(("min_date", F.col("sold_date") >= F.lit(min_date).cast("timestamp_ntz")))
    if max_date:
        steps.append(("max_date", F.col("sold_date") <= F.lit(max_date).cast("timestamp_ntz")))
    steps += [(f"has_{name}", F.col(name).isNotNull()) for name in require if name in df.columns]
    return steps


def filter_training(df: DataFrame, **options) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (c for _, c in training_steps(df, **options))))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows surviving each successive step and rows removed by it: one pass, one row per step."""
    reached, survivors = F.lit(True), [F.count("*").alias("s0")]
    for i, (_, condition) in enumerate(steps, 1):
        reached = reached & _true(condition)
        survivors.append(F.count_if(reached).alias(f"s{i}"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"s{i}").alias("rows_left"),
                 (F.col(f"s{i - 1}") - F.col(f"s{i}")).alias("rows_removed"))
        for i, (name, _) in enumerate(steps, 1)
    ])
    return df.agg(*survivors).select(F.inline(rows))


def filter_category(df: DataFrame, rule: CategoryRule) -> DataFrame:
    """Lots whose category text holds one of the rule's terms, within the rule's price range."""
    return df.filter(contains_any(F.col("raw_category"), rule.terms)
                     & F.col("price").between(rule.min_price, rule.max_price))


def filter_make_category(df: DataFrame, make: str, category: str, min_price=5_000, max_price=500_000) -> DataFrame:
    terms = MAKE_CATEGORY_TERMS.get(category, (category,))
    return df.filter((F.col("make_key") == make) & contains_any(F.col("raw_category"), terms)
                     & F.col("price").between(min_price, max_price))


def require_complete(df: DataFrame, fields: Iterable[str] = COMPLETE_FIELDS) -> DataFrame:
    """Lots with every field present; make_key stands in where the table has no make_model_key."""
    wanted = ["make_key" if f == "make_model_key" and f not in df.columns else f for f in fields]
    return df.dropna(subset=wanted)


def filter_other(df: DataFrame, rules=CATEGORY_RULES) -> DataFrame:
    """The residual segment: no category rule matches, its own price range, its own required fields."""
    residual = df.filter((category_key(F.col("raw_category"), rules) == OTHER.key)
                         & F.col("price").between(OTHER.min_price, OTHER.max_price))
    return require_complete(residual, OTHER_FIELDS)


def record_gate(df: DataFrame, keys: list[str], min_records: Column | int) -> DataFrame:
    """Rows per segment and whether the segment is large enough to train on."""
    return (df.groupBy(*keys).agg(F.count("*").alias("n_records"))
              .withColumn("trainable", (F.col("n_records") >= min_records).cast("int")))


def trainable_make_categories(df: DataFrame, min_records: int | None = None) -> DataFrame:
    """Lots per brand segment, joined to the rules by key, with the eligibility verdict."""
    from ..functions.rules import make_category_rules_table

    key = make_category_key(F.col("make_key"), F.col("raw_category"))
    counts = (df.withColumn("make_category_key", key).filter(F.col("make_category_key").isNotNull())
                .groupBy("make_category_key").agg(F.count("*").alias("n_records")))
    rules = make_category_rules_table(df.sparkSession)
    needed = F.lit(min_records) if min_records is not None else F.col("min_records")
    return (rules.join(counts, "make_category_key", "left")
                 .withColumn("n_records", F.coalesce("n_records", F.lit(0)))
                 .withColumn("trainable", (F.col("n_records") >= needed).cast("int")))


def usable(df: DataFrame | None = None) -> Column:
    return _true((F.col("price") > 0) & F.col("sold_date").isNotNull() & F.col("make_key").isNotNull())


def recent(as_of: str, years: int = 7) -> Column:
    """Sold within the last ``years`` of the given day."""
    return _true(F.col("sold_date") >= F.add_months(F.lit(as_of).cast("date"), -12 * years).cast("timestamp_ntz"))


def quality_checks() -> dict[str, Column]:
    present = {"has_sold_date": "sold_date", "has_year": "year", "has_hours": "hours", "has_make_key": "make_key",
               "has_model_id": "model_id", "has_region": "region", "has_condition": "raw_condition",
               "has_category": "raw_category"}
    return {"has_price": _true(F.col("price") > 0)} | {k: F.col(v).isNotNull() for k, v in present.items()}


def quality_summary(df: DataFrame, as_of: str) -> DataFrame:
    """Count and percentage for every quality check, for the usable lots and for the recent usable lots."""
    checks = {"total": F.lit(True), **quality_checks(), "usable": usable(), "usable_recent": usable() & recent(as_of)}
    counted = df.agg(*[a for name, c in checks.items()
                       for a in (F.count_if(c).alias(f"n_{name}"), share(c).alias(f"p_{name}"))])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(f"n_{name}").alias("n_rows"), F.col(f"p_{name}").alias("pct"))
        for name in checks
    ])
    return counted.select(F.inline(rows))
