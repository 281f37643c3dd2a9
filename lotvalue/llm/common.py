"""Helpers of the training-data operators: tables, stored intermediate results, connected components."""

from __future__ import annotations

import functools
import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotvalue.session import materialize

#: A word, as the size of a document and its shingles count it: bytes between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: no lineage to recompute, and one place for each row."""
    return materialize(df, label)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``store`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long), as (node, root): root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change; each step is a grouped minimum
    (combined before the shuffle) and a join, so a hub with a third of all edges is one key that adaptive execution
    may split. Nodes without an edge to another node are not returned.
    """
    def mark(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s"),
                     F.sum(F.xxhash64("v", "u") % 998_244_353).alias("t")).first()
        return tuple(row)

    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                "edges")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), "large_star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = store(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small_star")
        discard(large)
        marked = mark(after)
        discard(now)
        now = after
        if marked == seen:
            break
        seen = marked
    return (now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def row_hash(df: DataFrame):
    """A hash of a whole row, to tell rows apart whose doc_id is equal or null. Maps count as their JSON."""
    cells = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])     # a hash skips nulls
    return F.xxhash64(*cells, nulls)


#: The columns of ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def carried(stage):
    """``stage`` (documents in, documents out) for tables with further columns: these have other names inside it, so that none is taken
    for a helper column, and their own names again in what it returns."""
    @functools.wraps(stage)
    def run(docs: DataFrame) -> DataFrame:
        inside = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
        if not inside:
            return stage(docs)
        out = stage(docs.select(*[F.col(f"`{c}`").alias(inside.get(c, c)) for c in docs.columns]))
        return out.select(*[F.col(inside.get(c, c)).alias(c) for c in docs.columns])
    return run


def pick(docs: DataFrame, decided: DataFrame, *extra: str) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, row, n, and ``extra``) names, each once, with ``extra``.

    row: their ``row_hash``; n: how many equal rows there are. Rows equal in every column come out as one.
    """
    columns, names = docs.columns, [f"_x_{e}" for e in extra]
    # One row per document: joined in the same way at every size, not by broadcast where there happen to be few.
    right = decided.hint("merge").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("n").alias("_n"),
                           *[F.col(e).alias(x) for e, x in zip(extra, names)])
    held = docs.withColumn("_key", row_hash(docs)).join(
        right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")))
    once = held.where("_n = 1").select(*columns, *names)
    return once.unionByName(held.where("_n > 1").dropDuplicates(["_id", "_key"]).select(*columns, *names))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps whose results are stored by now.

    It does so once the driver has collected its garbage, which a driver with little to do may put off for half an hour.
    """
    for _ in range(2):          # Python lets go of its frames first, then the driver of what they held
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
