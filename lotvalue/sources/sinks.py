"""Parquet sinks and the build-once wrapper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .manifest import finished, list_inputs, read_manifest, remove, write_manifest


def by_sale_year(lots: DataFrame) -> DataFrame:
    """With ``sale_year``, gathered by it: a year's rows are in few tasks, and a year that is too large for one task is split."""
    return lots.withColumn("sale_year", F.year("sold_date")).hint("rebalance", "sale_year")


def write_training_data(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per sale year, so that date filters prune folders, with few files each."""
    write_arranged(by_sale_year(df), path, mode)


def write_arranged(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``write_training_data`` for rows that were gathered ``by_sale_year`` before the lookup tables made them wide."""
    df.write.mode(mode).partitionBy("sale_year").parquet(path)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                  write: Callable[[DataFrame, str], None] = write_training_data, inputs: list[str] | None = None,
                  params: dict | None = None) -> DataFrame:
    """The table at ``path`` if it was written to its end before; otherwise build it, write it and scan it.

    With ``inputs`` (paths, wildcards) it also has to be built anew if a file was added, changed or removed, or ``params``
    changed. The manifest that says so is written last. A table without a manifest counts as written if Spark's own mark of success is there.
    """
    files = list_inputs(spark, inputs) if inputs is not None else {}
    wanted = {"inputs": files, "params": params or {}}
    known = read_manifest(spark, path)
    if known == wanted or (known is None and inputs is None and finished(spark, path)):
        return spark.read.parquet(path)
    remove(spark, path)
    write(build(), path)
    write_manifest(spark, path, wanted)
    return spark.read.parquet(path)
