"""Features, encoding and boosted trees as MLlib stages: one ``Pipeline`` to fit, tune, save and load.

The stages hold what ``FeaturePipeline``, ``Preparation`` and the node table of ``forest`` hold; nothing is computed twice.
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import forest
from ..operators.features import FeatureConfig, FeaturePipeline, FittedFeatures
from ..operators.training import Preparation, TrainingConfig, boost

SLOT = "_stage_model"


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=kind)


class _Settable(Params):
    """Keyword arguments set params of the same name."""

    def setParams(self, **values):
        return self._set(**values)


class _TableWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance._save_tables(path)


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = self.cls._load_tables(self.sparkSession, path)
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        return instance


class _TableModel(Model, MLWritable, MLReadable):
    """A fitted stage whose state is tables and a line of JSON next to MLlib's own metadata."""

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


def _write_state(path: str, state: dict) -> None:
    SparkSession.active().createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{path}/state")


def _read_state(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/state").first()[0])


# -- features --------------------------------------------------------------------------------------------------

class _FeatureParams(_Settable):
    hoursPerYearCap = _param("hoursPerYearCap", "highest hours per year", TypeConverters.toFloat)
    equipmentAgeCap = _param("equipmentAgeCap", "highest age in years", TypeConverters.toInt)
    minCategoryFrequency = _param("minCategoryFrequency", "rows that a level needs not to be 'other'", TypeConverters.toInt)
    horsepowerScope = _param("horsepowerScope", "medians of the rows to transform (batch) or of the fitted ones (fitted)", TypeConverters.toString)
    hoursPerYear = _param("hoursPerYear", "keep, derive or auto", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        c = FeatureConfig(horsepower_scope="fitted")
        self._setDefault(hoursPerYearCap=c.hours_per_year_cap, equipmentAgeCap=c.equipment_age_cap, hoursPerYear=c.hours_per_year,
                         minCategoryFrequency=c.min_category_frequency, horsepowerScope=c.horsepower_scope)

    def config(self) -> FeatureConfig:
        def get(name):
            return self.getOrDefault(getattr(self, name))
        return FeatureConfig(get("hoursPerYearCap"), get("equipmentAgeCap"), get("minCategoryFrequency"), get("horsepowerScope"),
                             get("hoursPerYear"))


class LotFeatures(Estimator, _FeatureParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``FeaturePipeline``; the model adds the feature columns."""

    def __init__(self, **params):
        super().__init__()
        self.setParams(**params)

    def _fit(self, dataset: DataFrame) -> LotFeaturesModel:
        return self._copyValues(LotFeaturesModel(FeaturePipeline(self.config()).fit(dataset)))


class LotFeaturesModel(_TableModel, _FeatureParams):
    def __init__(self, fitted: FittedFeatures):
        super().__init__()
        self.fitted = fitted

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset)

    def _save_tables(self, path: str) -> None:
        self.fitted.save(f"{path}/fitted")

    @classmethod
    def _load_tables(cls, spark, path: str) -> LotFeaturesModel:
        return cls(FittedFeatures.load(spark, f"{path}/fitted"))


# -- encoding --------------------------------------------------------------------------------------------------

class _EncoderParams(_Settable, HasLabelCol, HasFeaturesCol):
    meanEncoded = _param("meanEncoded", "columns encoded by their mean label", TypeConverters.toListString)
    priorWeight = _param("priorWeight", "rows of the overall mean in each level's mean", TypeConverters.toFloat)
    folds = _param("folds", "number of folds", TypeConverters.toInt)
    foldCol = _param("foldCol", "fold of a training row, 0 to folds - 1; NULL or no such column for rows to score", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        c = TrainingConfig()
        self._setDefault(meanEncoded=list(c.mean_encoded), priorWeight=c.prior_weight, folds=c.folds, foldCol="_fold")

    def fold(self, dataset: DataFrame):
        name = self.getOrDefault(self.foldCol)
        return F.col(name) if name in dataset.columns else None


class LevelEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits ``Preparation``; the model adds filled, indexed and mean-encoded inputs and their vector.

    A row with a fold is encoded with the means of the other folds. Without a fold column training rows are encoded like all
    others, with means that hold their own label.
    """

    def __init__(self, **params):
        super().__init__()
        self.setParams(**params)

    def _fit(self, dataset: DataFrame) -> LevelEncoderModel:
        config = replace(TrainingConfig(), mean_encoded=tuple(self.getOrDefault(self.meanEncoded)),
                         prior_weight=self.getOrDefault(self.priorWeight), folds=self.getOrDefault(self.folds))
        fold = self.fold(dataset)
        fold = F.lit(0) if fold is None else fold
        return self._copyValues(LevelEncoderModel(Preparation.fit(dataset, F.col(self.getLabelCol()), config, fold)))


class LevelEncoderModel(_TableModel, _EncoderParams):
    def __init__(self, preparation: Preparation):
        super().__init__()
        self.preparation = preparation

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prepared = self.preparation.assembled(self.preparation.apply(dataset, self.fold(dataset)))
        name = self.getFeaturesCol()
        return prepared if name == "features" else prepared.withColumnRenamed("features", name)

    def _save_tables(self, path: str) -> None:
        p = self.preparation
        if p.means is not None:
            p.means.write.parquet(f"{path}/means")
        state = {"numeric": p.numeric, "indexed": p.indexed, "encoded": p.encoded, "fill": p.fill, "overall": p.overall,
                 "sizes": p.sizes, "labels": p.labels, "has_means": p.means is not None}
        _write_state(path, state)

    @classmethod
    def _load_tables(cls, spark, path: str) -> LevelEncoderModel:
        state = _read_state(spark, path)
        means = spark.read.parquet(f"{path}/means") if state.pop("has_means") else None
        return cls(Preparation(means=means, **state))


# -- trees -----------------------------------------------------------------------------------------------------

class _BoostingParams(_Settable, HasLabelCol, HasFeaturesCol, HasPredictionCol):
    maxIter = _param("maxIter", "rounds grown", TypeConverters.toInt)
    maxDepth = _param("maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = _param("stepSize", "weight of a tree", TypeConverters.toFloat)
    subsamplingRate = _param("subsamplingRate", "share of rows per tree", TypeConverters.toFloat)
    featureSubsetStrategy = _param("featureSubsetStrategy", "share of inputs per split", TypeConverters.toString)
    minInstancesPerNode = _param("minInstancesPerNode", "rows of a node", TypeConverters.toInt)
    seed = _param("seed", "seed", TypeConverters.toInt)
    patience = _param("patience", "rounds without a lower validation error", TypeConverters.toInt)
    validationCol = _param("validationCol", "true for rows that only measure the rounds; no such column: all rounds stay", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        c = TrainingConfig()
        self._setDefault(maxIter=c.max_iter, maxDepth=c.max_depth, stepSize=c.step_size, subsamplingRate=c.subsampling_rate,
                         featureSubsetStrategy=c.feature_subset, minInstancesPerNode=c.min_instances, seed=c.seed, patience=c.patience,
                         validationCol="_validation")

    def config(self) -> TrainingConfig:
        def get(name):
            return self.getOrDefault(getattr(self, name))
        return replace(TrainingConfig(), max_iter=get("maxIter"), max_depth=get("maxDepth"), step_size=get("stepSize"),
                       subsampling_rate=get("subsamplingRate"), feature_subset=get("featureSubsetStrategy"),
                       min_instances=get("minInstancesPerNode"), seed=get("seed"), patience=get("patience"))


class PatientBoosting(Estimator, _BoostingParams, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees cut back to the round with the lowest validation error; the model is a table of nodes."""

    def __init__(self, **params):
        super().__init__()
        self.setParams(**params)

    def _fit(self, dataset: DataFrame) -> TreeTableModel:
        features, name = self.getFeaturesCol(), self.getOrDefault(self.validationCol)
        measures = F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in dataset.columns else F.lit(False)
        boosted, curve, rounds = boost(dataset.filter(~measures), dataset.filter(measures), self.getLabelCol(), features, self.config())
        attributes = dataset.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
        named = {a["idx"]: a.get("name") for own in attributes.values() for a in own}
        inputs = [named.get(i) or f"input_{i}" for i in range(len(boosted.binning.counts))]
        nodes = boosted.nodes(dataset.sparkSession, inputs, rounds)
        return self._copyValues(TreeTableModel(nodes, inputs, curve, rounds))


class TreeTableModel(_TableModel, _BoostingParams):
    def __init__(self, nodes: DataFrame, inputs: list[str], curve: list[float], best_iteration: int):
        super().__init__()
        self.nodes, self.inputs, self.curve, self.best_iteration = nodes, inputs, curve, best_iteration

    def _transform(self, dataset: DataFrame) -> DataFrame:
        tagged, one = dataset.withColumn(SLOT, F.lit("m")), self.nodes.withColumn(SLOT, F.lit("m"))
        x = vector_to_array(F.col(self.getFeaturesCol()))
        return forest.with_scores(tagged, x, one, self.inputs, SLOT, name=self.getPredictionCol()).drop(SLOT)

    def importance(self) -> DataFrame:
        return forest.importance(self.nodes, [(i, i) for i in self.inputs])

    def _save_tables(self, path: str) -> None:
        self.nodes.write.parquet(f"{path}/nodes")
        _write_state(path, {"inputs": self.inputs, "curve": self.curve, "best_iteration": self.best_iteration})

    @classmethod
    def _load_tables(cls, spark, path: str) -> TreeTableModel:
        return cls(spark.read.parquet(f"{path}/nodes"), **_read_state(spark, path))
