import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from checks import inputs as i
from checks.model_queries import MODEL_COLUMNS
from lotvalue.ml.stages import LevelEncoder, LotFeatures, PatientBoosting
from lotvalue.operators import training
from lotvalue.operators.training import TrainingConfig, train_model
from lotvalue.session import materialize

CONFIG = TrainingConfig(max_iter=4, max_depth=4, min_instances=5, step_size=0.5)
TREES = {"maxIter": 4, "maxDepth": 4, "minInstancesPerNode": 5, "stepSize": 0.5}


@pytest.fixture(scope="module")
def lots(spark, sf_dir):
    return i.stored_training(spark, sf_dir, *i.TIES, *MODEL_COLUMNS)


@pytest.fixture(scope="module")
def split(lots):
    """Labelled rows in the order that the present path trains on, with split and fold, without its features."""
    ready = training.prepare(lots, i.TIES, CONFIG)
    own = ready.featured.select(*i.TIES, "split", "_fold")
    joined = lots.join(own, i.TIES).withColumn("label", F.log("price")).withColumn("_validation", F.col("split") == "val")
    return ready, materialize(joined, "labelled")


@pytest.fixture(scope="module")
def fitted(split):
    """The three stages, fitted as one pipeline on training and validation rows."""
    pipeline = Pipeline(stages=[LotFeatures(), LevelEncoder(labelCol="label"), PatientBoosting(labelCol="label", **TREES)])
    return pipeline.fit(split[1].filter("split = 'train'"))


def test_pipeline_equals_the_present_path(lots, split):
    """Features and encodings fitted by stages equal those of ``train_model``; so do the trees on equal vectors."""
    ready, labelled = split
    model = train_model(lots, "all", "log", i.TIES, CONFIG, prepared=ready)
    features = LotFeatures().fit(labelled.filter("split = 'train'"))
    assert features.fitted.stats == pytest.approx(ready.fitted.stats) and features.fitted.counts == ready.fitted.counts
    featured = ready.featured.withColumn("label", F.log("price"))
    encoder = LevelEncoder(labelCol="label").fit(featured.filter("split = 'train'"))
    assert encoder.preparation.inputs == model.preparation.inputs and encoder.preparation.labels == model.preparation.labels
    vectors = encoder.transform(featured).withColumn("_validation", F.col("split") == "val").filter("split <> 'test'")
    trees = PatientBoosting(labelCol="label", **TREES).fit(vectors)
    assert trees.best_iteration == model.metadata["best_iteration"] and trees.curve == pytest.approx(model.metadata["curve"])
    columns = ["tree", "node", "feature", "left", "right", "rows"]
    assert trees.nodes.select(*columns).exceptAll(model.nodes.select(*columns)).isEmpty()
    scored = PipelineModel([features, encoder, trees]).transform(lots).select(*i.TIES, F.exp("prediction").alias("a"))
    both = scored.join(model.predict(lots).select(*i.TIES, F.col("prediction").alias("b")), i.TIES)
    assert both.count() >= lots.count() and both.filter("abs(a - b) > 1e-6 * b OR a IS NULL").isEmpty()


def test_saved_pipeline_scores_alike(split, fitted, tmp_path):
    rows = split[1].filter("split = 'test'").limit(200)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    assert [s.uid for s in loaded.stages] == [s.uid for s in fitted.stages]
    assert loaded.stages[2].getOrDefault("maxDepth") == 4 and loaded.stages[2].best_iteration == fitted.stages[2].best_iteration
    a, b = (m.transform(rows).agg(F.sum("prediction")).first()[0] for m in (fitted, loaded))
    assert a == pytest.approx(b)
    unfitted = Pipeline(stages=[LotFeatures(minCategoryFrequency=7), PatientBoosting(patience=3)])
    unfitted.write().save(str(tmp_path / "u"))
    again = Pipeline.load(str(tmp_path / "u")).getStages()
    assert again[0].config().min_category_frequency == 7 and again[1].config().patience == 3


def test_cross_validation_picks_the_better_depth(split):
    trees = PatientBoosting(labelCol="label", **TREES | {"maxIter": 3})
    grid = ParamGridBuilder().addGrid(trees.maxDepth, [1, 5]).build()
    search = CrossValidator(estimator=Pipeline(stages=[LotFeatures(), LevelEncoder(labelCol="label"), trees]), estimatorParamMaps=grid,
                            evaluator=RegressionEvaluator(labelCol="label"), numFolds=2, seed=1)
    found = search.fit(split[1].drop("_validation"))
    assert len(found.avgMetrics) == 2 and found.avgMetrics[1] < found.avgMetrics[0]
    assert found.bestModel.stages[2].getOrDefault("maxDepth") == 5
