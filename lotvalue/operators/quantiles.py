"""Exact grouped quantiles that stay distributed when one group holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .joins import row_bytes

# Largest number of distinct values of one group that a single aggregation buffer may hold.
MAX_VALUES_PER_GROUP = 2_000_000


def stacked(df: DataFrame, variants: list[list], carried: list) -> DataFrame:
    """Each row once per variant: the carried columns plus the variant's. A single variant needs no generator."""
    if len(variants) == 1:
        return df.select(*carried, *variants[0])
    return df.select(*carried, F.inline(F.array(*[F.struct(*v) for v in variants])))


def value_counts_long(df: DataFrame, keys: list[str], measures: dict, weight: str | None = None) -> DataFrame:
    """(keys, measure, value) -> n for several measures in one scan; missing keys and values are left out.

    The shuffle key includes the value, so a hot group is spread over all tasks. ``weight`` names a column that
    says how many rows an input row stands for.
    """
    pairs = [[F.lit(name).alias("measure"), expr.cast("double").alias("value")] for name, expr in measures.items()]
    rows = df.dropna(subset=keys) if keys else df
    times = F.col(weight) if weight else F.lit(1)
    return (stacked(rows, pairs, [*keys, times.cast("bigint").alias("times")])
                .filter(F.col("value").isNotNull())
                .groupBy(*keys, "measure", "value").agg(F.sum("times").alias("n")))


def stored_value_counts(df: DataFrame, keys: list[str], measures: dict, weight: str | None = None) -> DataFrame:
    return materialize(value_counts_long(df, keys, measures, weight), "value-counts")


def sized_group_quantiles(df: DataFrame, keys: list[str], measures: dict, probs: list[float],
                          weight: str | None = None, counted: DataFrame | None = None,
                          max_values: int = MAX_VALUES_PER_GROUP) -> tuple[DataFrame, int]:
    """keys, measure, n_values, one column ``q0..qk`` per probability; and the result's size in bytes.

    Positions between two values are interpolated linearly. ``counted`` passes value counts that are stored already.

    Distinct values are counted first. When every group is small the built-in percentile finishes the work;
    otherwise values are range-sorted across tasks and each wanted position is found by its running count.
    """
    if counted is None:
        counted = stored_value_counts(df, keys, measures, weight)
    group = [*keys, "measure"]
    groups = counted.groupBy(*group).count()
    largest, size = groups.agg(F.max("count"), F.sum(row_bytes(groups) + 16 * len(probs))).first()
    if (largest or 0) > max_values:
        return _ranked_quantiles(counted, group, probs), size
    wanted = F.percentile("value", F.array(*[F.lit(p) for p in probs]), F.col("n"))
    found = counted.groupBy(*group).agg(F.sum("n").alias("n_values"), wanted.alias("q"))
    return found.select(*group, "n_values", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))]), size or 0


def group_quantiles(df: DataFrame, keys: list[str], measures: dict, probs: list[float], **options) -> DataFrame:
    return sized_group_quantiles(df, keys, measures, probs, **options)[0]


def _ranked_quantiles(counted: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    # A global sort puts values into range partitions; the upper bits of the id name the partition. Writing the
    # result fixes it, so that both uses below see the same placement.
    placed = materialize(
        counted.orderBy(*group, "value").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)),
        "value-ranges")
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (placed.groupBy(*group, "part").agg(F.sum("n").alias("part_n"))
                   .withColumn("start", F.coalesce(F.sum("part_n").over(before), F.lit(0)))
                   .withColumn("total", F.sum("part_n").over(Window.partitionBy(*group))))
    positions = F.array(*[
        F.struct(F.lit(i).alias("prob_no"), (F.lit(p) * (F.col("total") - 1)).alias("exact"))
        for i, p in enumerate(probs)
    ])
    ends = F.array(*[
        F.struct(F.lit(side).alias("side"), edge(F.col("exact")).cast("bigint").alias("position"))
        for side, edge in (("low", F.floor), ("high", F.ceil))
    ])
    wanted = (parts.select(*group, "part", "start", "part_n", "total", F.inline(positions))
                   .select(*group, "part", "start", "part_n", "total", "prob_no", "exact", F.inline(ends))
                   .filter((F.col("position") >= F.col("start"))
                           & (F.col("position") < F.col("start") + F.col("part_n"))))
    running = Window.partitionBy(*group, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hit = (placed.join(wanted.select(*group, "part").distinct(), [*group, "part"], "left_semi")
                 .withColumn("upto", F.sum("n").over(running))
                 .join(wanted, [*group, "part"])
                 .filter((F.col("start") + F.col("upto") - F.col("n") <= F.col("position"))
                         & (F.col("position") < F.col("start") + F.col("upto"))))
    pairs = hit.groupBy(*group, "total", "prob_no", "exact").agg(
        F.max(F.when(F.col("side") == "low", F.col("value"))).alias("low"),
        F.max(F.when(F.col("side") == "high", F.col("value"))).alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("exact") - F.floor("exact"))
    return pairs.groupBy(*group).agg(F.max("total").alias("n_values"), *[
        F.max(F.when(F.col("prob_no") == i, value)).alias(f"q{i}") for i in range(len(probs))
    ])


def group_medians(df: DataFrame, keys: list[str], measures: dict, **options) -> DataFrame:
    """keys plus one median column per measure, named as the measure."""
    found = group_quantiles(df, keys, measures, [0.5], **options)
    medians = [F.max(F.when(F.col("measure") == name, F.col("q0"))).alias(name) for name in measures]
    return found.groupBy(*keys).agg(*medians) if keys else found.agg(*medians)
