"""The feature pipeline: quantities fitted on training lots, applied as column expressions and lookups."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import clip, coerce_number
from ..functions.rules import condition_grade, condition_score, hp_segment
from ..session import materialize
from .impute import cascade_horsepower, horsepower_medians
from .joins import lookup_join, row_bytes, table_bytes

# The model inputs, in order.
CATEGORICAL = ["make_model_key", "region", "utilization_bucket", "raw_category", "condition"]
NUMERIC = [
    "year", "hours", "equipment_age", "hours_per_year", "is_current_production", "years_since_discontinued",
    "sale_month", "sale_quarter", "month_sin", "month_cos", "is_planting_season", "is_harvest_season",
    "barometer_norm", "sentiment_spread", "investment_confidence", "diesel_relative", "el_nino_phase",
    "log_make_volume", "log_model_volume", "condition_score", "horsepower",
]
RARE_CHECKED = ["make_model_key", "region", "raw_category"]

# Defaults and seasons.
DEFAULT_HORSEPOWER = 150.0
DEFAULT_HOURS_PER_YEAR = 500
PLANTING_MONTHS = (2, 3, 4, 5)
HARVEST_MONTHS = (8, 9, 10, 11)
UNFITTED = {"barometer_mean": 100.0, "barometer_std": 20.0, "diesel_mean": 3.5}

SPECS_DDL = "horsepower string, drive string, features array<string>, attachments array<string>"


@dataclass(frozen=True)
class FeatureConfig:
    hours_per_year_cap: float = 2000.0
    equipment_age_cap: int = 50
    min_category_frequency: int = 20
    horsepower_scope: str = "batch"      # medians over the rows being transformed, or "fitted" on training rows
    hours_per_year: str = "auto"         # "keep" an existing column, "derive" it, or "auto": derive if all null


def feature_columns() -> tuple[list[str], list[str]]:
    return list(CATEGORICAL), list(NUMERIC)


# -- row features ----------------------------------------------------------------------------------------------

def parse_specs(specs: Column) -> Column:
    """Hash notation to a struct: '=>' becomes ':', 'nil' becomes 'null'. Malformed text gives NULL fields.

    Text that is not enclosed in braces is no object and is not handed to the parser, whose errors are costly.
    """
    text = F.replace(F.replace(specs, F.lit("=>"), F.lit(":")), F.lit("nil"), F.lit("null"))
    enclosed = text.rlike(r"^\s*\{") & text.rlike(r"\}\s*$")
    return F.when(enclosed, F.from_json(text, SPECS_DDL, {"allowSingleQuotes": "false"}))


def parsed_horsepower(specs: Column) -> Column:
    return coerce_number(parse_specs(specs)["horsepower"], "string")


def spec_flags(df: DataFrame) -> DataFrame:
    """Drive, cab, guidance, air conditioning and attachment count from ``specs``.

    Terms are substrings of list elements, so 'ac' is also found inside 'tractor'.
    """
    parsed = df.withColumn("_specs", parse_specs(F.col("specs")))
    items = F.col("_specs.features")

    def lists(*terms: str) -> Column:
        hit = F.exists(items, lambda x: F.lower(x).rlike("|".join(terms)))
        return F.coalesce(hit, F.lit(False)).cast("int")

    drive = F.lower(F.coalesce("_specs.drive", F.lit("")))
    return parsed.withColumns({
        "drive_type": drive,
        "is_4wd": drive.contains("4").cast("int"),
        "has_cab": lists("cab"),
        "has_gps": lists("gps", "guidance"),
        "has_ac": lists("ac", "air"),
        "num_attachments": F.coalesce(F.size("_specs.attachments"), F.lit(0)),
    }).drop("_specs")


def add_condition(df: DataFrame) -> DataFrame:
    grade = condition_grade(F.col("raw_condition")) if "raw_condition" in df.columns else condition_grade(
        F.lit(None).cast("string"))
    return df.withColumn("condition", grade).withColumn("condition_score", condition_score(F.col("condition")))


def add_age_and_use(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """equipment_age, hours_per_year and utilization_bucket."""
    out = df
    if {"sold_date", "year"} <= set(df.columns):
        age = clip(F.year("sold_date") - F.col("year"), 0.0, float(config.equipment_age_cap))
        out = out.withColumn("equipment_age", age)
    if _derive_hours_per_year(df, config) and {"hours", "equipment_age"} <= set(out.columns):
        age = F.col("equipment_age")
        out = out.withColumn("hours_per_year",
                             F.when(age > 0, F.col("hours") / age).otherwise(F.col("hours")))
    if "hours_per_year" not in out.columns:
        return out
    return (out.withColumn("hours_per_year", clip(F.col("hours_per_year"), high=config.hours_per_year_cap))
               .withColumn("utilization_bucket", utilization_bucket(F.col("hours_per_year"))))


def _derive_hours_per_year(df: DataFrame, config: FeatureConfig) -> bool:
    if "hours_per_year" not in df.columns or config.hours_per_year == "derive":
        return True
    if config.hours_per_year == "keep":
        return False
    return df.filter(F.col("hours_per_year").isNotNull()).isEmpty()


def utilization_bucket(hours_per_year: Column) -> Column:
    """Bands open below and closed above: (0,300], (300,600], (600,1000], (1000,...). Zero is in none."""
    h = F.coalesce(hours_per_year, F.lit(DEFAULT_HOURS_PER_YEAR))
    return (F.when(h > 1000, "extreme").when(h > 600, "heavy").when(h > 300, "normal").when(h > 0, "light"))


def add_production_status(df: DataFrame) -> DataFrame:
    if "make_production_year_end" not in df.columns:
        return df.withColumns({"is_current_production": F.lit(1), "years_since_discontinued": F.lit(0.0)})
    end = F.col("make_production_year_end")
    new = {"is_current_production": end.isNull().cast("int")}
    if "sold_date" in df.columns:
        new["years_since_discontinued"] = F.when(end.isNotNull(), clip(F.year("sold_date") - end, low=0)) \
            .otherwise(0).cast("double")
    return df.withColumns(new)


def add_equipment(df: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    return add_production_status(add_age_and_use(add_condition(df), config))


def add_temporal(df: DataFrame) -> DataFrame:
    if "sold_date" not in df.columns:
        return df
    month = F.month("sold_date")
    angle = 2 * F.pi() * month / 12
    return df.withColumns({
        "sale_month": month,
        "sale_quarter": F.quarter("sold_date"),
        "sale_year": F.year("sold_date"),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "is_planting_season": month.isin(*PLANTING_MONTHS).cast("int"),
        "is_harvest_season": month.isin(*HARVEST_MONTHS).cast("int"),
    })


def add_macro(df: DataFrame, stats: dict) -> DataFrame:
    """Economic indicators relative to the fitted statistics, which are numbers or columns of ``df``."""
    have, new = set(df.columns), {}
    known = {**UNFITTED, **stats}

    def positive(v) -> bool:
        return isinstance(v, Column) or (v is not None and v > 0)

    if "barometer" in have:
        std = known["barometer_std"]
        norm = (F.col("barometer") - F.lit(known["barometer_mean"])) / F.lit(std) if positive(std) else F.lit(0.0)
        new["barometer_norm"] = F.when(std > 0, norm).otherwise(0.0) if isinstance(std, Column) else norm
    if {"future_expectations", "current_conditions"} <= have:
        new["sentiment_spread"] = F.col("future_expectations") - F.col("current_conditions")
    if "capital_investment_index" in have:
        new["investment_confidence"] = F.col("capital_investment_index") / 100
    if "diesel_price" in have and positive(known["diesel_mean"]):
        mean = F.lit(known["diesel_mean"])
        new["diesel_relative"] = F.when(mean > 0, F.col("diesel_price") / mean)
    return df.withColumns(new) if new else df


def recency_weight(age_years: Column) -> Column:
    """Training weight exp(-0.1 x age in years): recent sales count more."""
    return F.exp(F.lit(-0.1) * age_years)


def add_hp_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("hp_segment", hp_segment(F.col("horsepower")))


# -- fitted part -----------------------------------------------------------------------------------------------

def frequency_table(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, level) -> n for several text columns in one scan; missing values are left out."""
    return (df.select(*features).unpivot([], features, "feature", "level")
              .filter(F.col("level").isNotNull())
              .groupBy("feature", "level").agg(F.count("*").alias("n")))


def fit_statistics(df: DataFrame) -> DataFrame:
    """One row: mean and sample deviation of the barometer, mean diesel price."""
    wanted = []
    if "barometer" in df.columns:
        wanted += [F.avg("barometer").alias("barometer_mean"), F.stddev_samp("barometer").alias("barometer_std")]
    if "diesel_price" in df.columns:
        wanted.append(F.avg("diesel_price").alias("diesel_mean"))
    return df.agg(*(wanted or [F.count("*").alias("n_rows")]))


class FeaturePipeline:
    def __init__(self, config: FeatureConfig | None = None):
        self.config = config or FeatureConfig()

    def fit(self, df: DataFrame) -> FittedFeatures:
        wanted = [*RARE_CHECKED, "raw_model"] + ([] if "make_model_key" in df.columns else ["make_key"])
        features = [f for f in wanted if f in df.columns]

        def fit_levels() -> tuple[DataFrame, dict]:
            levels = materialize(frequency_table(df, features), "levels")
            measured = levels.groupBy("feature").agg(F.count("*").alias("n"), F.sum(row_bytes(levels)).alias("size"))
            return levels, {r["feature"]: r for r in measured.collect()}                          # one per feature

        def fit_medians() -> tuple[DataFrame | None, int]:
            if self.config.horsepower_scope != "fitted" or "specs" not in df.columns:
                return None, 0
            medians, size = horsepower_medians(df.withColumn("horsepower", parsed_horsepower(F.col("specs"))))
            return materialize(medians, "horsepower-medians"), size

        with ThreadPoolExecutor(max_workers=2) as pool:        # small steps, none of which needs another's outcome
            known, middle = pool.submit(fit_levels), pool.submit(fit_medians)
            stats = {k: v for k, v in fit_statistics(df).first().asDict().items() if k in UNFITTED}
            (levels, found), (medians, hp_size) = known.result(), middle.result()
        counts = {f: found[f]["n"] if f in found else 0 for f in features}
        sizes = {f: found[f]["size"] if f in found else 0 for f in features}
        return FittedFeatures(self.config, stats, levels, counts, sizes, medians, hp_size)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass(frozen=True)
class FittedFeatures:
    """What ``fit`` learned: scalars, one frequency table, optionally horsepower medians.

    ``keys`` names columns of the tables, and of the rows to transform, that tell several fits apart; ``stats`` and ``counts`` are
    columns then.
    """

    config: FeatureConfig
    stats: dict
    levels: DataFrame
    counts: dict                            # levels per feature
    sizes: dict                             # bytes per feature
    hp_medians: DataFrame | None = None
    hp_size: int = 0
    keys: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.add_horsepower(df)
        out = add_macro(add_temporal(add_equipment(out, self.config)), self.stats)
        return self.add_levels(out)

    def add_horsepower(self, df: DataFrame) -> DataFrame:
        if "specs" not in df.columns:
            return df.withColumn("horsepower", F.lit(DEFAULT_HORSEPOWER))
        parsed = df.withColumn("horsepower", parsed_horsepower(F.col("specs")))
        medians, size = self.hp_medians, self.hp_size
        if medians is None:
            medians, size = horsepower_medians(parsed)
        return cascade_horsepower(parsed, medians, size, DEFAULT_HORSEPOWER, self.keys)

    def _with_count(self, df: DataFrame, feature: str) -> DataFrame:
        table = self.levels.filter(F.col("feature") == feature).select(
            *self.keys, F.col("level").alias(feature), F.col("n").alias(f"_n_{feature}"))
        return lookup_join(df, table, [*self.keys, feature], self.sizes[feature], weight=f"_n_{feature}")

    def add_levels(self, df: DataFrame) -> DataFrame:
        """Volumes from the original keys first, then rare and missing levels become 'other'."""
        present = [f for f in self.counts if f in df.columns]
        out = df
        for feature in present:
            out = self._with_count(out, feature)
        new = {}
        for feature in ("make_model_key", "make_key"):
            if feature in present:
                new["make_volume"] = F.coalesce(f"_n_{feature}", F.lit(1))
                break
        if "raw_model" in present:          # without any fitted model the count is 1 and its log 0
            has_models = F.lit(self.counts["raw_model"]) > 0
            new["model_volume"] = F.when(has_models, F.coalesce("_n_raw_model", F.lit(1))).otherwise(1)
            log_volume = F.when(has_models, F.log1p("model_volume")).otherwise(0.0)
        else:
            new["model_volume"], log_volume = F.lit(1), F.lit(0.0)
        out = out.withColumns(new)
        logs = {"log_model_volume": log_volume}
        if "make_volume" in new:
            logs["log_make_volume"] = F.log1p("make_volume")
        enough = self.config.min_category_frequency
        rare = {f: F.when(F.col(f"_n_{f}") >= enough, F.col(f)).otherwise("other")
                for f in RARE_CHECKED if f in present}
        return out.withColumns({**logs, **rare}).drop(*[f"_n_{f}" for f in present])

    def valid_levels(self) -> DataFrame:
        return self.levels.filter((F.col("n") >= self.config.min_category_frequency)
                                  & F.col("feature").isin(RARE_CHECKED))

    def save(self, path: str) -> None:
        self.levels.write.mode("overwrite").parquet(f"{path}/levels")
        spark = self.levels.sparkSession
        if self.hp_medians is not None:
            self.hp_medians.write.mode("overwrite").parquet(f"{path}/horsepower")
        state = {"config": asdict(self.config), "stats": self.stats, "counts": self.counts, "sizes": self.sizes,
                 "hp_size": self.hp_size, "has_hp_medians": self.hp_medians is not None}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedFeatures:
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        medians = spark.read.parquet(f"{path}/horsepower") if state["has_hp_medians"] else None
        return FittedFeatures(FeatureConfig(**state["config"]), state["stats"], spark.read.parquet(f"{path}/levels"),
                              state["counts"], state["sizes"], medians, state["hp_size"])


def with_scope(fitted: FittedFeatures, **changes) -> FittedFeatures:
    return replace(fitted, config=replace(fitted.config, **changes))


def model_volume_by_make(df: DataFrame) -> DataFrame:
    """Sales per (make, model), attached to every lot; documented as an alternative to the volume by model."""
    keys = ["make_key", "raw_model"]
    volumes = materialize(df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("model_volume")), "volumes")
    joined = lookup_join(df, volumes, keys, table_bytes(volumes), weight="model_volume")
    return joined.withColumn("model_volume", F.coalesce("model_volume", F.lit(0)))
