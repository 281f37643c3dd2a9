"""Prediction quality, each measure as one aggregation over the scored lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import share
from .quantiles import group_medians

# Accuracy goals on the test part.
GOALS = {"mape": ("<", 10.0), "r2": (">", 0.85), "rmse": ("<", 15_000.0)}
ERROR_BANDS = (5, 10, 20, 33, 50)


def metrics(scored: DataFrame, keys: list[str], actual: str = "price", predicted: str = "prediction") -> DataFrame:
    """n, RMSE, MAPE (in percent) and R2 per group. R2 is NULL where all prices of a group are equal."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    squared = F.sum(e * e)
    spread = F.var_pop(y) * F.count(y)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.try_divide(F.abs(e), F.abs(y))) * 100).alias("mape"),
        (1 - F.try_divide(squared, spread)).alias("r2"))


def goal_check(registry: DataFrame, prefix: str = "test_") -> DataFrame:
    """One met_* flag per goal, and how many are met."""
    flags = {}
    for name, (side, goal) in GOALS.items():
        value = F.col(f"{prefix}{name}")
        flags[f"met_{name}"] = F.coalesce(value < goal if side == "<" else value > goal, F.lit(False)).cast("int")
    return registry.withColumns(flags).withColumn("goals_met", sum((F.col(f) for f in flags), F.lit(0)))


def with_errors(scored: DataFrame, actual: str = "price", predicted: str = "prediction") -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return scored.withColumns({"error": error, "abs_error": F.abs(error),
                               "pct_error": F.abs(F.try_divide(error, F.col(actual)) * 100)})


def error_analysis(scored: DataFrame, bands=ERROR_BANDS) -> DataFrame:
    """Means, medians and the count and share of predictions within each band: one row."""
    errors = with_errors(scored)
    aggregates = [F.count("*").alias("n"), F.avg("price").alias("mean_actual"),
                  F.avg("prediction").alias("mean_predicted"), F.avg("abs_error").alias("mean_abs_error"),
                  F.avg("pct_error").alias("mean_pct_error")]
    for b in bands:
        within: Column = F.col("pct_error") <= b
        aggregates += [F.count_if(within).alias(f"n_within_{b}"), share(within).alias(f"pct_within_{b}")]
    medians = group_medians(errors, [], {"median_abs_error": F.col("abs_error"),
                                         "median_pct_error": F.col("pct_error")})
    return errors.agg(*aggregates).crossJoin(medians)


def error_ecdf(scored: DataFrame, step: float = 0.5) -> DataFrame:
    """Share of predictions whose percentage error is at most t, for every step t at which the share grows.

    Rows are reduced to counts per step first; the running sum is over the occupied steps only, up to the largest error.
    """
    counts = (with_errors(scored).filter(F.col("pct_error").isNotNull())
              .groupBy(F.ceil(F.col("pct_error") / step).alias("bin")).agg(F.count("*").alias("n")))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.select((F.col("bin") * step).alias("pct_error"), F.sum("n").over(upto).alias("n_upto"),
                         (F.sum("n").over(upto) / F.sum("n").over(every) * 100).alias("cumulative_pct"))
