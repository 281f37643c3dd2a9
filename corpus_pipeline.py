"""A training corpus from ``documents``: quality, repeated lines, near-duplicates, mixture, packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotvalue.llm import linededup, mixing, packing, quality, simhash
from lotvalue.llm.common import release, store, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, documents stay."""
    return linededup.without_repeats(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def _mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times."""
    return mixing.mixed(docs)


def _sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document and its place in a sequence."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", _quality),
    ("line dedup", _lines),
    ("simhash near-dedup", _near_duplicates),
    ("mixing", _mixture),
    ("best-fit packing", _sequences),
]

#: Tokens, a fitted classifier and random rounding are not SQL; tests/llm/test_pipeline.py holds the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
