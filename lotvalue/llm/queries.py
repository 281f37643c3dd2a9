"""The registered queries of this package: name, function of (spark, sf_dir), and SQL where it can express the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collisions, hardnegatives, htmltext, langid, linededup, mixing, mtree, packing, periodic, quality, secretscan, simhash, substrings,
)
from .common import WORD, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


SQL["op3_line_dedup"] = linededup.SQL


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"), text=False).drop("kept")


@query
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.nearest(table(spark, sf_dir, "embeddings"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose vec_id is divisible by 7 move on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query
def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(table(spark, sf_dir, "documents"))


SQL["op12_secrets"] = secretscan.SQL


def with_periods(docs: DataFrame) -> DataFrame:
    """docs in which a tenth of the texts, told by their doc_id, repeat a part of theirs from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = docs.select("doc_id", "text", h.alias("_h"))         .withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))         .withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_n", F.coalesce(F.size("_words"), F.lit(0)))
    a = (F.col("_g") % F.col("_n")).cast("int")
    p = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    out = out.withColumn("_a", F.when(F.col("_n") > 0, a)).withColumn("_p", p)
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), times))
    text = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), again), F.lit(1), F.col("_n")), " ")
    return out.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
