"""The model registry as a table, and the choice of model for every row of a request table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import (
    OTHER, category_key, category_rules_table, make_category_key, make_category_rules_table,
)
from .evaluate import metrics

TIERS = ("make_category", "category", "generic")
METHODS = ("regular", "log")
# Weights of the documented ensemble, by method.
ENSEMBLE_WEIGHTS = {"log": 0.5, "regular": 0.3, "third": 0.2}


def registry_from_scores(scored: DataFrame) -> DataFrame:
    """One row per (tier, model_key, method): split sizes, and val and test metrics side by side.

    ``scored`` holds tier, model_key, method, split, price and prediction.
    """
    keys = ["tier", "model_key", "method"]
    measured = metrics(scored, [*keys, "split"])

    def of(split: str, name: str):
        return F.max(F.when(F.col("split") == split, F.col(name)))

    columns = [F.coalesce(of(s, "n"), F.lit(0)).alias(f"n_{s}") for s in ("train", "val", "test")]
    columns += [of(s, m).alias(f"{s}_{m}") for s in ("val", "test") for m in ("rmse", "mape", "r2")]
    return measured.groupBy(*keys).agg(*columns).withColumn(
        "target_transform", F.when(F.col("method") == "log", "log").otherwise("none"))


def route_keys(requests: DataFrame) -> DataFrame:
    """The segment keys a request could be served by."""
    return requests.withColumns({
        "make_category_key": make_category_key(F.col("make_key"), F.col("raw_category")),
        "category_key": category_key(F.col("raw_category")),
    })


def route(requests: DataFrame, registry: DataFrame, method: str = "log") -> DataFrame:
    """Adds model_key and tier: the most specific registered model of the method, NULL if there is none.

    The registry of one method has one row per rule at most, a few dozen, so it is broadcast.
    """
    registered = registry.filter(F.col("method") == method)

    def of(tier: str, key: str) -> DataFrame:
        hits = registered.filter(F.col("tier") == tier)
        return F.broadcast(hits.select(F.col("model_key").alias(key), F.col("model_key").alias(f"_{tier}")).distinct())

    generic = F.broadcast(registered.filter((F.col("tier") == "generic") & (F.col("model_key") == OTHER.key))
                          .agg(F.max("model_key").alias("_generic")))
    keyed = route_keys(requests)
    hit = (keyed.join(of("make_category", "make_category_key"), "make_category_key", "left")
                .join(of("category", "category_key"), "category_key", "left")
                .crossJoin(generic))
    tier = (F.when(F.col("_make_category").isNotNull(), TIERS[0]).when(F.col("_category").isNotNull(), TIERS[1])
             .when(F.col("_generic").isNotNull(), TIERS[2]))
    return hit.withColumn("tier", tier).withColumn(
        "model_key", F.coalesce("_make_category", "_category", "_generic")
    ).drop("_make_category", "_category", "_generic")


def with_model_info(routed: DataFrame, registry: DataFrame, method: str = "log") -> DataFrame:
    """The routed model's sample size and test metrics on every request."""
    info = registry.filter(F.col("method") == method).select(
        "tier", "model_key", "n_train", "test_rmse", "test_mape", "test_r2")
    return routed.join(F.broadcast(info), ["tier", "model_key"], "left")      # a few dozen rows


def route_coverage(routed: DataFrame) -> DataFrame:
    """Requests served by each tier and their share of all."""
    tiers = routed.groupBy(F.coalesce("tier", F.lit("none")).alias("tier")).agg(F.count("*").alias("n_requests"))
    total = tiers.agg(F.sum("n_requests").alias("_total"))
    return tiers.crossJoin(F.broadcast(total)).select(
        "tier", "n_requests", (F.col("n_requests") / F.col("_total") * 100).alias("pct"))


def available_models(registry: DataFrame, methods=METHODS) -> DataFrame:
    """Every model the rules ask for, per method, and whether the registry has it."""
    spark = registry.sparkSession
    tier = F.when(F.col("category_key") == OTHER.key, TIERS[2]).otherwise(TIERS[1])
    expected = category_rules_table(spark).select(tier.alias("tier"), F.col("category_key").alias("model_key")).unionByName(
        make_category_rules_table(spark).select(F.lit(TIERS[0]).alias("tier"), F.col("make_category_key").alias("model_key")))
    expected = expected.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    known = registry.select("tier", "model_key", "method", "n_train", "test_mape")
    return expected.join(known, ["tier", "model_key", "method"], "left").select(
        "tier", "model_key", "method", F.col("n_train").isNotNull().cast("int").alias("available"), "test_mape")


def run_summary(registry: DataFrame) -> DataFrame:
    """Models trained, average MAPE and R2, per method."""
    return registry.groupBy("method").agg(
        F.count("*").alias("n_models"), F.avg("test_mape").alias("mean_mape"), F.avg("test_r2").alias("mean_r2"))


def best_models(registry: DataFrame, top: int = 5) -> DataFrame:
    return registry.orderBy("test_mape", "tier", "model_key", "method").limit(top)


def method_improvement(registry: DataFrame) -> DataFrame:
    """Per model, both methods' MAPE and the relative gain of the log method in percent."""
    by_model = registry.groupBy("tier", "model_key").agg(*[
        F.max(F.when(F.col("method") == m, F.col("test_mape"))).alias(f"{m}_mape") for m in METHODS])
    both = by_model.filter(F.col("regular_mape").isNotNull() & F.col("log_mape").isNotNull())
    return both.withColumn(
        "gain_pct", F.try_divide(F.col("regular_mape") - F.col("log_mape"), F.col("regular_mape")) * 100)


def specific_improvement(registry: DataFrame, rules_to_category: DataFrame, method: str = "log") -> DataFrame:
    """Each brand segment against the category model that would serve it otherwise."""
    one = registry.filter(F.col("method") == method)
    specific = one.filter(F.col("tier") == "make_category").select(
        F.col("model_key").alias("make_category_key"), F.col("test_mape").alias("specific_mape"))
    general = one.filter(F.col("tier") == "category").select(
        F.col("model_key").alias("category_key"), F.col("test_mape").alias("general_mape"))
    return (specific.join(rules_to_category, "make_category_key").join(general, "category_key")
                    .withColumn("change_pct", (F.try_divide("specific_mape", "general_mape") - 1) * 100))


def ensemble(predictions: DataFrame, keys: list[str], weights: dict = ENSEMBLE_WEIGHTS) -> DataFrame:
    """Weighted sum of the methods' predictions per lot; lots lacking a method are left out.

    ``predictions`` is long: keys, method, prediction.
    """
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col("method") == name, F.lit(w)).otherwise(weight)
    known = predictions.withColumn("_weight", weight).filter(F.col("_weight").isNotNull())
    return (known.groupBy(*keys).agg(F.count("*").alias("_n"),
                                     F.sum(F.col("prediction") * F.col("_weight")).alias("prediction"))
                 .filter(F.col("_n") == len(weights)).drop("_n"))
