"""Session helpers and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A lookup table larger than this is no longer broadcast (see joins.lookup_join).
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def build_session(app_name: str = "lotvalue", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Wide projections compile to methods over 8,000 bytecodes, which the JVM would leave to its interpreter.
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lotvalue-"))
    return spark.sparkContext.getCheckpointDir()


_scopes: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop


def run_dir(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables; it is deleted when the driver ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    system, path = _file_system(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside the block when it ends: write results before that."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for folder in made:
            system, path = _file_system(spark, folder)
            system.delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A folder for one intermediate table."""
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage to recompute when an executor is lost, fixed row placement for operators that
    depend on it, and a real file size that Spark's own broadcast threshold can judge.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if partition_by:
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
