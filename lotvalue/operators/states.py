"""Fitted quantities as states per part of the data, which merge into those of any set of parts without reading it again.

Moments (count, mean, sum of squared deviations) and level counts merge exactly. Sketches of distinct values (HLL) and of
quantiles (KLL) merge within their stated errors; the exact ways stay what ``profiling`` and ``quantiles`` use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.manifest import changed, list_inputs, overwrite_partitions, read_manifest, remove, write_manifest

#: log2 of the buckets of a distinct sketch: a standard error of about 1.04 / sqrt(4096), 1.6 %.
LG_BUCKETS = 12
#: Size of a quantile sketch. Its normalized rank error is about 1.3 % at 99 % confidence, 0.7 % at 400.
KLL_K = 200


def _per_column(df: DataFrame, keys: list[str], columns: list[str], fields: Callable[[str], list[Column]]) -> DataFrame:
    """keys, feature and ``fields`` of each column: one aggregation over all columns."""
    names = [f"_f{i}" for i in range(len(columns))]
    wide = df.groupBy(*keys).agg(*[F.struct(F.lit(c).alias("feature"), *fields(c)).alias(n) for c, n in zip(columns, names)])
    return wide.select(*keys, F.inline(F.array(*names)))


# -- exact states ----------------------------------------------------------------------------------------------

def moment_states(df: DataFrame, part: str, columns: list[str]) -> DataFrame:
    """part, feature, n, mean, m2 (sum of squared deviations from the part's mean); missing values are left out."""
    return _per_column(df, [part], columns, lambda c: [
        F.count(c).alias("n"), F.coalesce(F.avg(c), F.lit(0.0)).cast("double").alias("mean"),
        F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)).alias("m2")])


def merge_moments(states: DataFrame) -> DataFrame:
    """feature, n, mean, m2, std (of the sample) over all parts of ``states``.

    Deviations of the parts' means are taken from the overall mean, so nothing cancels as it would in sums of squares.
    """
    own = Window.partitionBy("feature")
    weighed = states.withColumn("all", F.try_divide(F.sum(F.col("n") * F.col("mean")).over(own), F.sum("n").over(own)))
    spread = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("all"), 2)
    merged = weighed.groupBy("feature").agg(F.sum("n").alias("n"), F.max("all").alias("mean"), F.sum(spread).alias("m2"))
    return merged.withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))


def level_states(df: DataFrame, part: str, features: list[str]) -> DataFrame:
    """part, feature, level, n."""
    return (df.select(part, *features).unpivot([part], features, "feature", "level").filter(F.col("level").isNotNull())
              .groupBy(part, "feature", "level").agg(F.count("*").alias("n")))


def merge_levels(states: DataFrame) -> DataFrame:
    return states.groupBy("feature", "level").agg(F.sum("n").alias("n"))


def merged_fit(moments: DataFrame) -> DataFrame:
    """What ``fit_statistics`` gives, from states: barometer_mean, barometer_std, diesel_mean."""
    def of(feature: str, value: str) -> Column:
        return F.max(F.when(F.col("feature") == feature, F.col(value)))

    return merge_moments(moments).agg(of("barometer", "mean").alias("barometer_mean"), of("barometer", "std").alias("barometer_std"),
                                      of("diesel_price", "mean").alias("diesel_mean"))


# -- sketches --------------------------------------------------------------------------------------------------

def distinct_states(df: DataFrame, part: str, columns: list[str], lg_buckets: int = LG_BUCKETS) -> DataFrame:
    """part, feature, sketch."""
    return _per_column(df, [part], columns, lambda c: [F.hll_sketch_agg(c, lg_buckets).alias("sketch")])


def merge_distinct(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, feature, n_distinct: estimated, whatever the order in which parts were made or merged."""
    merged = states.groupBy(*(by or []), "feature").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def quantile_states(df: DataFrame, part: str, keys: list[str], columns: list[str], k: int = KLL_K) -> DataFrame:
    """part, keys, feature, sketch: some kilobytes per group, and no value counts. Missing values are left out."""
    return _per_column(df, [part, *keys], columns, lambda c: [F.kll_sketch_agg_double(F.col(c).cast("double"), k).alias("sketch")])


def merge_quantiles(states: DataFrame, keys: list[str], probs: list[float], k: int = KLL_K) -> DataFrame:
    """keys, feature, n, and q0, q1, ... for ``probs``. Each lies within the rank error of the sketch."""
    merged = states.groupBy(*keys, "feature").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    n = F.kll_sketch_get_n_double("sketch")
    return merged.select(*keys, "feature", n.alias("n"), *[
        F.when(n > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias(f"q{i}") for i, p in enumerate(probs)])


# -- stored states ---------------------------------------------------------------------------------------------

def update_states(spark: SparkSession, folder: str, parts: dict[str, str], read: Callable[[str], DataFrame],
                  kinds: dict[str, Callable[[DataFrame, str], DataFrame]]) -> list[str]:
    """Bring the states under ``folder``/kind up to date with ``parts`` (name -> path) and return the names that were read.

    Only parts that are new or whose files changed are read, in one scan for each kind; the states of parts that are gone are removed.
    ``kinds`` maps a name to a function of (rows, name of the part column). The manifest is written last, so work that did
    not come to its end is done again.
    """
    files = {name: list_inputs(spark, [path]) for name, path in parts.items()}
    now = {"inputs": {name: sorted(f.items()) for name, f in files.items()}, "kinds": sorted(kinds)}
    now["inputs"] = {name: [[f, *v] for f, v in f_] for name, f_ in now["inputs"].items()}
    old = read_manifest(spark, folder)
    if old is None or old["kinds"] != now["kinds"]:
        old = {"inputs": {}}
        remove(spark, folder)
    new, gone = changed(old, now["inputs"])
    for kind, states in kinds.items():
        for name in [*new, *gone]:
            remove(spark, f"{folder}/{kind}/part={name}")
        if new:
            rows = None
            for name in new:
                own = read(name).withColumn("part", F.lit(name))
                rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
            overwrite_partitions(states(rows, "part"), f"{folder}/{kind}", "part")
    if new or gone:
        write_manifest(spark, folder, now)
    return new


def fit_kinds(features: list[str], columns: tuple[str, ...] = ("barometer", "diesel_price")) -> dict:
    """The states that the feature pipeline's statistics and frequency table are merged from."""
    return {"moments": lambda df, part: moment_states(df, part, list(columns)),
            "levels": lambda df, part: level_states(df, part, features)}
